"""Text extraction over large collections of settings documents.

Documents are rows; every operator works on the whole text inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from ..missing import as_list, check_columns, quoted
from .rows import counter, drop_duplicate_rows, top_n

# Patterns of settings documents.
ENTRY = r'<entry\s+key="([^"]*)"\s+[^>]*value="([^"]*)"'
STATEMENT = r'(?i)<entry\s+key="statement"\s+[^>]*value="([^"]*)"'
QUERY = r'(?i)<entry\s+key="query"\s+[^>]*value="([^"]*)"'
SELECT_TEXT = r"(?is)SELECT\s+.+?\s+FROM\s+.+?(?:WHERE|ORDER|GROUP|LIMIT|;|$)"
SELECT_VALUE = r'(?i)value="([^"]*SELECT[^"]*)"'
FACTORY = r"(?:org|com)\.[a-zA-Z0-9_.]+NodeFactory[a-zA-Z0-9_$]*"
CONNECTOR_FACTORY = r"(?:org|com)\.[a-zA-Z0-9_.]+(?:Connector|Api)Factory[a-zA-Z0-9_$]*"
JDBC_URL = r"(jdbc:[a-zA-Z0-9+:/_.\-@]+)"
ADDRESS = r"//([^:/]+):?(\d+)?/?([^;?]*)"
DATABASE_NAME = r"databaseName=([^;]+)"
QUOTED_PROJECT = r"`([a-zA-Z0-9_-]+)\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+`"
INSTANCE_HINT = r"INSTANCIA:\s*(\S+)"
DATABASE_HINT = r"BANCO DE DADOS:\s*([^\n*]+)"
NODE_NUMBER = r"\s*\(#\d+\)$"

# Database factories recognised by content, in order.
DATABASE_FACTORIES = (
    "DBReaderNodeFactory",
    "DBQueryReaderNodeFactory",
    "DatabaseLoopingNodeFactory",
    "DBLoaderNodeFactory",
    "DatabaseConnectorNodeFactory",
    "GoogleApiConnectorFactory",
    "BigQueryDBConnectorNodeFactory",
)

# Escaped character entities, in replacement order.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&#xA;", "\n"),
    ("&#xD;", "\r"),
    ("&#x9;", "\t"),
)

# Fragment of a factory name -> database type, first match wins.
FACTORY_TYPES = (
    ("BigQuery", "bigquery"),
    ("GoogleApi", "google_api"),
    ("JDBC", "jdbc"),
    ("MySQL", "mysql"),
    ("Postgres", "postgres"),
    ("SQLServer", "mssql"),
    ("MSSQL", "mssql"),
    ("Oracle", "oracle"),
    ("Hive", "hive"),
    ("Snowflake", "snowflake"),
    ("Redshift", "redshift"),
    ("SQLite", "sqlite"),
    ("Mongo", "mongodb"),
    ("Cassandra", "cassandra"),
    ("H2", "h2"),
    ("DB2", "db2"),
    ("Sybase", "sybase"),
    ("Teradata", "teradata"),
    ("Vertica", "vertica"),
    ("MariaDB", "mariadb"),
    ("DBLoader", "db_loader"),
    ("DBReader", "db_reader"),
    ("DBWriter", "db_writer"),
    ("DBQueryReader", "db_query_reader"),
    ("DatabaseLooping", "db_looping"),
    ("DatabaseConnector", "jdbc"),
)

# Fragment of a lower-case driver class -> database type, first match wins.
DRIVER_TYPES = (
    ("sybase", "sybase"),
    ("mysql", "mysql"),
    ("postgres", "postgres"),
    ("oracle", "oracle"),
    ("sqlserver", "mssql"),
    ("jtds", "mssql"),
    ("hive", "hive"),
    ("snowflake", "snowflake"),
    ("redshift", "redshift"),
    ("sqlite", "sqlite"),
    ("h2", "h2"),
    ("db2", "db2"),
    ("teradata", "teradata"),
    ("vertica", "vertica"),
    ("mariadb", "mariadb"),
    ("bigquery", "bigquery"),
)

# Clause keywords that start a line, in the order they are treated.
CLAUSES = (
    "SELECT",
    "FROM",
    "WHERE",
    "AND",
    "OR",
    "JOIN",
    "LEFT JOIN",
    "RIGHT JOIN",
    "INNER JOIN",
    "ON",
    "GROUP BY",
    "ORDER BY",
    "HAVING",
    "LIMIT",
    "UNION",
)

# Translation methods in report order.
METHODS = ("Dedicado", "Determinístico", "Injeção Direta", "LLM", "Template", "Fallback")

# Words of a template label -> translation method, first match wins.
METHOD_WORDS = (
    (("Deterministic", "deterministic"), "Determinístico"),
    (("LLM", "llm"), "LLM"),
    (("Injected", "injected"), "Injeção Direta"),
    (("Extracted",), "Template"),
)

# Part of a template label -> kind of node, translation; first match wins.
SPECIAL_TEMPLATES = (
    ("StringManip_Deterministic", "StringManipulation", "Expressão → .apply(lambda)"),
    ("StringManip_LLM", "StringManipulation (LLM)", "Expressão → LLM → pandas"),
    ("StringManip_Extracted", "StringManipulation", "Expressão extraída (template)"),
    ("JavaSnippet_Deterministic", "Java Snippet", "if/else Java → np.where()"),
    ("JavaEditVar_Deterministic", "Java Edit Variable", "Atribuição simples → flow var"),
    ("Java_LLM", "Java Snippet (LLM)", "Código Java → LLM → pandas"),
    ("PythonScript_Injected", "Python2Script", "Código Python extraído e injetado"),
    ("PythonScript_Extracted", "Python2Script", "Código Python (AST falhou)"),
)

# Words of a factory name, besides the fragments of a type, that make it a database node.
DATABASE_WORDS = ("Connector", "Database")

# A noncharacter, which marks places of a text while it is worked on.
MARK = "\ufdd0"

# Entry keys that say something about a connection.
CONNECTION_KEYS = (
    "driver", "database", "database_name", "db_type", "db_dialect",
    "db_driver", "host", "port", "schema", "table", "catalog",
    "user", "userName", "credential", "auth_type",
    "service_account_email", "key_file_location",
    "project", "project_id", "dataset", "location", "region",
    "warehouse", "role", "account", "instance",
    "timeout", "connection_timeout", "query_timeout",
    "url", "server", "server_name", "sid", "service_name",
    "statement", "sql_statement", "query",
    "insert_mode", "if_exists", "batch_size",
    "port_object_summary",
)

# The keys among them that hold a whole number.
NUMBER_KEYS = ("port", "timeout", "connection_timeout", "query_timeout", "batch_size")


def _col(col: str | Column) -> Column:
    return quoted(col) if isinstance(col, str) else col


def first_match(col: str | Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, missing if there is none or it is empty."""
    return F.nullif(F.regexp_extract(_col(col), pattern, group), F.lit(""))


def first_nonempty_pattern(col: str | Column, patterns: Sequence[str | tuple[str, int]]) -> Column:
    """First match of the first pattern that matches with some text."""
    pairs = [(p, 1) if isinstance(p, str) else p for p in patterns]
    return F.coalesce(*[first_match(col, p, g) for p, g in pairs])


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _character(code: Column) -> Column:
    """Character of a five-digit decimal code; surrogate halves stay escaped."""
    n = code.try_cast("int")
    # char() covers one byte and is much cheaper than decoding.
    return (
        F.when(n < 256, F.char(n))
        .when(n.between(0xD800, 0xDFFF), F.concat(F.lit("%%"), code))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _decoded_pieces(text: Column) -> Column:
    """The text cut at its escapes, each piece decoded for itself."""
    pieces = F.split(text, r"%%(?=[0-9]{5})")
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    decoded = lambda piece: F.concat(_character(F.substring(piece, 1, 5)), F.substring(piece, 6, 2**31 - 1))
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(rest, decoded), ""))


def decode_escapes(col: str | Column) -> Column:
    """Replace ``%%ddddd`` by the character of that decimal code.

    Codes of surrogate halves are no characters of a text and stay as they are.
    The escapes are marked in one pass by a noncharacter; then each code that occurs is replaced wherever it
    is marked, so what was decoded is not read again.  A text that holds the mark is decoded piece by piece.
    """
    text = _col(col)
    marked = F.regexp_replace(text, r"%%([0-9]{5})", MARK + "$1")
    # Codes, not escapes, are walked through: few per text.
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"%%([0-9]{5})"), 1))
    replaced = F.aggregate(
        codes, marked, lambda done, code: F.replace(done, F.concat(F.lit(MARK), code), _character(code))
    )
    unsafe = text.contains(MARK) | text.contains(f"%%{ord(MARK):05d}")
    return F.when(~text.contains("%%"), text).when(unsafe, _decoded_pieces(text)).otherwise(replaced)


def encode_escapes(col: str | Column, chars: str = " ") -> Column:
    """Write the given characters as ``%%ddddd``; the inverse of :func:`decode_escapes` on texts without ``%%``."""
    return reduce(
        lambda text, ch: F.replace(text, F.lit(ch), F.lit(f"%%{ord(ch):05d}")), chars, _col(col)
    )


def unescape_entities(col: str | Column) -> Column:
    """Replace the character entities one kind after the other."""
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, _col(col))


def extract_sql(df: DataFrame, col: str, out: str = "sql", search_text: bool = True) -> DataFrame:
    """SQL text of a document: the statement entry, the query entry, a SELECT … FROM text
    (unless ``search_text`` is off), then the longest value with a SELECT.

    Escapes and entities are decoded; a document without SQL gives a missing value.
    """
    values = F.regexp_extract_all(quoted(col), F.lit(SELECT_VALUE), 1)
    # Longest value, the first of equally long ones.
    longest = F.get(
        F.array_sort(
            F.transform(values, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))
        ),
        F.lit(0),
    )["v"]
    found = [first_match(col, STATEMENT), first_match(col, QUERY)]
    if search_text:
        found.append(first_match(col, SELECT_TEXT, 0))
    found.append(longest)
    # Decoding mentions the text several times: a column of its own is searched for once per row.
    coded = df.withColumn("__coded", F.coalesce(*found))
    decoded = strip(unescape_entities(decode_escapes("__coded"))).alias(out)
    kept = [quoted(c) for c in df.columns]
    if out in df.columns:
        kept[df.columns.index(out)] = decoded
    else:
        kept.append(decoded)
    return coded.select(*kept)


def extract_entries(
    df: DataFrame, col: str, id_cols: Sequence[str] | str, pattern: str = ENTRY, drop_placeholders: bool = True
) -> DataFrame:
    """(ids, ``key``, ``value``) rows of the documents; the first entry of a key wins.

    ``pattern`` has two groups, key and value.  Values are trimmed; empty ones, and with
    ``drop_placeholders`` those like ``<…>`` or an editor's remark, are left out.
    """
    ids = as_list(id_cols)
    check_columns(df, ids)
    keys = F.regexp_extract_all(quoted(col), F.lit(pattern), 1)
    values = F.regexp_extract_all(quoted(col), F.lit(pattern), 2)
    # Sorted by key and place, the first entry of a key follows another key: no shuffle needed.
    entries = F.array_sort(
        F.transform(
            F.arrays_zip(keys.alias("key"), values.alias("value")),
            lambda e, i: F.struct(e["key"].alias("key"), i.alias("place"), e["value"].alias("value")),
        )
    )
    is_first = lambda e, i: ~e["key"].eqNullSafe(F.get(F.col("__entries"), i - 1)["key"])
    first = (
        df.select(*[quoted(c) for c in ids], entries.alias("__entries"))
        .select(*[quoted(c) for c in ids], F.inline(F.filter("__entries", is_first)))
        .select(*[quoted(c) for c in ids], "key", strip("value").alias("value"))
        .where("value <> ''")
    )
    if drop_placeholders:
        bracketed = F.col("value").startswith("<") & F.col("value").endswith(">")
        first = first.where(~bracketed & ~F.col("value").startswith("[Workflows edited"))
    return first


def parse_jdbc_url(df: DataFrame, col: str) -> DataFrame:
    """Add ``subprotocol``, ``host``, ``port`` and ``database_name`` of a database address.

    Forms: ``//host:port/db``, ``jdbc:x:y:host:port`` and ``databaseName=db``.
    """
    url = quoted(col)
    parts = F.split(url, ":")
    has_address = url.rlike(ADDRESS)
    in_parts = ~has_address & (F.size(parts) >= 5)
    port = F.when(has_address, first_match(url, ADDRESS, 2)).when(
        in_parts, F.get(F.split(F.get(parts, F.lit(4)), "/"), F.lit(0))
    )
    return df.withColumns(
        {
            "subprotocol": F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))),
            "host": F.when(has_address, first_match(url, ADDRESS, 1)).when(in_parts, F.get(parts, F.lit(3))),
            "port": port.try_cast("bigint"),
            "database_name": F.coalesce(first_match(url, ADDRESS, 3), first_match(url, DATABASE_NAME)),
        }
    )


def classify_by_fragment(
    col: str | Column, rules: Sequence[tuple[str, str]], default: str = "unknown", lower: bool = False
) -> Column:
    """Label of the first fragment the text contains."""
    text = F.lower(_col(col)) if lower else _col(col)
    chain = reduce(lambda c, rule: c.when(text.contains(rule[0]), rule[1]), rules, F)
    return chain.otherwise(F.lit(default))


def factory_type(col: str | Column) -> Column:
    return classify_by_fragment(col, FACTORY_TYPES, "unknown")


def driver_type(col: str | Column) -> Column:
    return classify_by_fragment(col, DRIVER_TYPES, "jdbc", lower=True)


def sql_hints(df: DataFrame, sql: str, database_name: str | None = None, database: str | None = None) -> DataFrame:
    """Add the hints a SQL text carries: ``project_from_sql`` (back-quoted three-part name),
    ``hint_instance``, ``hint_database`` (comments) and ``project``, for which the
    database columns come first."""
    project = first_match(sql, QUOTED_PROJECT)
    named = [F.nullif(quoted(c), F.lit("")) for c in (database_name, database) if c]
    return df.withColumns(
        {
            "project_from_sql": project,
            "hint_instance": first_match(sql, INSTANCE_HINT),
            "hint_database": strip(first_match(sql, DATABASE_HINT)),
            "project": F.coalesce(*named, project),
        }
    )


def simple_class(col: str | Column) -> Column:
    return F.element_at(F.split(_col(col), r"\."), -1)


def _factory(text: Column) -> Column:
    """Factory class a document names, or a database factory it mentions."""
    by_content = reduce(lambda c, name: c.when(text.contains(name), name), DATABASE_FACTORIES, F)
    return F.coalesce(first_match(text, FACTORY, 0), first_match(text, CONNECTOR_FACTORY, 0), by_content)


def node_inventory(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(``path``, ``name``, ``factory``, ``sql``) of the documents that describe a node.

    The name is the folder without its `` (#n)`` number.  SQL is extracted for
    database readers only.
    """
    text = quoted(content)
    factory = _factory(text)
    folder = F.get(F.reverse(F.split(quoted(path), "/")), F.lit(1))
    reads = reduce(Column.__or__, [text.contains(f) for f in ("DBReader", "DBQueryReader", "DatabaseLooping")])
    found = docs.withColumns(
        {"name": F.regexp_replace(folder, NODE_NUMBER, ""), "factory": factory}
    ).where("factory IS NOT NULL")
    found = extract_sql(found, content, "sql", search_text=False)
    return found.select(quoted(path).alias("path"), "name", "factory", F.when(reads, F.col("sql")).alias("sql"))


def entry_columns(
    df: DataFrame, col: str, keys: Sequence[str], prefix: str = "__", internal: str | None = None,
    keep_internal: Sequence[str] = (),
) -> DataFrame:
    """Add a column ``<prefix><key>`` for each key: the trimmed value of its first entry.

    Empty values and placeholders are missing, and so are values that hold the text
    ``internal``, save for the keys in ``keep_internal``.  The entries of all keys
    are found together.
    """
    pattern = F.lit(ENTRY.replace('"([^"]*)"', f'"({"|".join(keys)})"', 1))

    def held(key: Column, value: Column) -> Column:
        shown = (value != "") & ~(value.startswith("<") & value.endswith(">")) & ~value.startswith("[Workflows edited")
        if internal:
            shown &= ~value.contains(internal) | key.isin(list(keep_internal))
        return F.when(shown, value)

    found = df.withColumns({"__keys": F.regexp_extract_all(quoted(col), pattern, 1),
                            "__values": F.transform(F.regexp_extract_all(quoted(col), pattern, 2), strip)})
    found = found.withColumn("__values", F.zip_with("__keys", "__values", held))
    # The first place of a key counts from 1; 0 says that there is none.
    value = lambda key: F.expr(f"get(__values, cast(array_position(__keys, '{key}') - 1 AS int))").alias(prefix + key)
    return found.select(*[quoted(c) for c in df.columns], *[value(key) for key in keys])


def connection_info(docs: DataFrame, path: str = "path", content: str = "content", internal: str | None = None) -> DataFrame:
    """What the settings documents of database nodes say about their connection, a row per document.

    Columns: ``path``, ``factory``, ``db_type``, ``is_connector``, ``is_load``, ``jdbc_url``,
    ``subprotocol``, ``host``, ``port``, ``database_name``, ``driver``, ``user``, ``schema``,
    ``table``, ``project``, ``hint_instance``, ``hint_database``, then the other
    entries of :data:`CONNECTION_KEYS` under their own names, SQL texts excepted.  Entries come before
    the parts of the address, a type given as an entry before one by factory before one by
    driver.  The project is that of the database columns or the SQL for BigQuery, the
    database for a loader, else the entry.  Values that hold the text ``internal`` do not count.
    """
    text = quoted(content)
    hints = [*[fragment for fragment, _ in FACTORY_TYPES], *DATABASE_WORDS]
    # One pattern: the filter is pushed down, and each mention of the factory is computed again there.
    nodes = docs.select(
        quoted(path).alias("path"), simple_class(_factory(text)).alias("factory"), text.alias("__content")
    ).where(F.col("factory").rlike("|".join(hints)))
    found = entry_columns(
        nodes, "__content", [*CONNECTION_KEYS, "databaseUrl"], internal=internal, keep_internal=["port_object_summary"]
    )
    entry = lambda key: F.col(f"__{key}")
    found = found.select(
        "*",
        F.coalesce(first_match("__content", JDBC_URL), entry("databaseUrl")).alias("jdbc_url"),
        F.coalesce(entry("sql_statement"), entry("statement"), entry("query")).alias("__sql"),
    ).drop("__content")

    by_node = F.coalesce(entry("db_type"), factory_type("factory")).alias("__by_node")
    found = sql_hints(parse_jdbc_url(found, "jdbc_url"), "__sql", "__database_name", "__database").select("*", by_node)
    by_driver = F.col("__by_node").isin("unknown", "jdbc", "db_looping", "db_reader") & entry("driver").isNotNull()
    has = lambda *words: reduce(Column.__or__, [F.col("factory").contains(w) for w in words])
    db_type = F.when(by_driver, driver_type("__driver")).otherwise(F.col("__by_node"))
    of_type = F.when(db_type == "bigquery", F.col("project")).when(db_type == "db_loader", entry("database"))
    number = lambda key: entry(key).try_cast("bigint")
    named = {"db_type", "host", "port", "database_name", "driver", "user", "userName", "schema", "table", "project",
             "statement", "sql_statement", "query"}
    return found.select(
        "path",
        "factory",
        db_type.alias("db_type"),
        has("Connector", "Api").alias("is_connector"),
        has("Loader", "Writer").alias("is_load"),
        "jdbc_url",
        "subprotocol",
        F.coalesce(entry("host"), "host").alias("host"),
        F.coalesce(number("port"), "port").alias("port"),
        F.coalesce(entry("database_name"), "database_name").alias("database_name"),
        entry("driver").alias("driver"),
        F.coalesce(entry("user"), entry("userName")).alias("user"),
        entry("schema").alias("schema"),
        entry("table").alias("table"),
        F.coalesce(of_type, entry("project"), entry("project_id")).alias("project"),
        "hint_instance",
        "hint_database",
        *[(number(k) if k in NUMBER_KEYS else entry(k)).alias(k) for k in CONNECTION_KEYS if k not in named],
    )


def coverage_stats(nodes: DataFrame, matched: str = "matched") -> DataFrame:
    """One row: ``total``, ``matched``, ``fallback`` and ``coverage`` in percent, one decimal."""
    sums = nodes.agg(F.count("*").alias("total"), F.count_if(quoted(matched)).alias("matched"))
    pct = F.when(F.col("total") > 0, F.col("matched") * 100.0 / F.col("total")).otherwise(0.0)
    return sums.select(
        "total", "matched", (F.col("total") - F.col("matched")).alias("fallback"), F.bround(pct, 1).alias("coverage")
    )


def top_factories(nodes: DataFrame, factory: str = "factory", n: int = 20) -> DataFrame:
    """(``factory``, ``count``) of the ``n`` most frequent simple class names, ties by name."""
    name = F.coalesce(F.nullif(simple_class(factory), F.lit("")), F.lit("Unknown"))
    counts = nodes.groupBy(name.alias("factory")).agg(F.count("*").alias("count"))
    return top_n(counts, n, ["count", "factory"], [False, True])


def method_label(template: Column, matched: Column) -> Column:
    """Translation method by the words of a template label."""
    has = lambda words: reduce(Column.__or__, [template.contains(w) for w in words])
    chain = F.when(~F.coalesce(matched, F.lit(False)), "Fallback")
    for words, method in METHOD_WORDS:
        chain = chain.when(has(words), method)
    return chain.when((template != "") & (template != "template"), "Dedicado").otherwise("Template")


def node_methods(
    nodes: DataFrame, keep: Sequence[str] | str = (), template: str = "template", matched: str = "matched"
) -> DataFrame:
    """A row per node: the columns ``keep``, ``method``, and for special templates their
    ``special``, ``kind`` and ``translation`` (missing for the others).

    The method of a dedicated, deterministic or language-model template names it in brackets.
    """
    label, known = quoted(template), F.coalesce(quoted(matched), F.lit(False))
    with_template = lambda name: F.concat(F.lit(f"{name} ("), label, F.lit(")"))
    method = (
        F.when(~known, "Fallback")
        .when(label.contains("Deterministic") | label.contains("deterministic"), with_template("Determinístico"))
        .when(label.contains("LLM"), with_template("LLM"))
        .when(label.contains("Injected"), "Injeção Direta")
        .when((label != "") & (label != "template"), with_template("Dedicado"))
        .otherwise("Template")
    )
    special = F.when(known, reduce(lambda c, row: c.when(label.contains(row[0]), row[0]), SPECIAL_TEMPLATES, F))
    of_special = lambda at: reduce(lambda c, row: c.when(F.col("special") == row[0], row[at]), SPECIAL_TEMPLATES, F)
    return nodes.select(
        *[quoted(c) for c in as_list(keep)], method.alias("method"), special.alias("special")
    ).withColumns({"kind": of_special(1), "translation": of_special(2)})


def node_list(
    nodes: DataFrame,
    order_by: Sequence[str] | str,
    name_width: int = 30,
    name: str = "name",
    factory: str = "factory",
    template: str = "template",
    matched: str = "matched",
) -> DataFrame:
    """(``number``, ``name``, ``factory``, ``method``, ``line``) of all nodes: first those with a translation, then
    the others, each in the given order, numbered from 1.

    Names are cut to ``name_width``; ``line`` is the row of the list report.  ``order_by`` must identify
    the nodes.
    """
    order, names = as_list(order_by), (name, factory, template)
    cells = nodes.select(
        (~F.coalesce(quoted(matched), F.lit(False))).alias("__late"),
        *[quoted(c).alias(f"__o{i}") for i, c in enumerate(order)],
        *[quoted(c).alias(n) for c, n in zip(names, ("name", "factory", "template"))],
        quoted(matched).alias("matched"),
    )
    kept = ["__late", *[f"__o{i}" for i in range(len(order))], "name", "factory"]
    listed = node_methods(cells, kept).select(*kept, "method")
    numbered = counter(listed, kept[:-2], "number", unique=True).withColumn("name", F.substring("name", 1, name_width))
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, ("number", "name", "factory", "method"))), F.lit(" |"))
    return numbered.select("number", "name", "factory", "method", line.alias("line"))


def method_distribution(nodes: DataFrame, template: str = "template", matched: str = "matched") -> DataFrame:
    """(``position``, ``method``, ``count``, ``pct``) of the methods that occur, in report order."""
    label = method_label(quoted(template), quoted(matched)).alias("method")
    counts = nodes.groupBy(label).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    position = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    return counts.select(
        position.cast("bigint").alias("position"),
        "method",
        "count",
        F.bround(F.col("count") * 100.0 / total, 1).alias("pct"),
    ).orderBy("position")


def fallback_groups(
    nodes: DataFrame, order_by: Sequence[str] | str, factory: str = "factory", name: str = "name",
    matched: str = "matched", sample_chars: int | None = None,
) -> DataFrame:
    """Unmatched nodes per class: first name, count and report cell, largest first.

    The name is cut to ``sample_chars`` characters if that is given.
    """
    place = F.struct(*[quoted(o) for o in as_list(order_by)])
    groups = (
        nodes.where(~F.coalesce(quoted(matched), F.lit(False)))
        .groupBy(simple_class(factory).alias("factory"))
        .agg(F.min_by(quoted(name), place).alias("sample"), F.count("*").alias("count"))
    )
    if sample_chars is not None:
        groups = groups.withColumn("sample", F.substring("sample", 1, sample_chars))
    cell = F.when(
        F.col("count") > 1, F.concat("sample", F.lit("... ("), F.col("count").cast("string"), F.lit("x)"))
    ).otherwise(F.col("sample"))
    return groups.withColumn("cell", cell).orderBy(F.desc("count"), "factory")


def split_clauses(col: str | Column) -> Column:
    """SQL text with a line break before each clause keyword, keywords in upper case.

    A keyword the text does not hold costs a plain search, no pattern match.
    """
    text = _col(col)
    words = F.array(*[F.lit(w) for w in CLAUSES])
    held = _bind(F.upper(text), lambda upper: F.filter(words, lambda word: upper.contains(word)))
    broken = F.aggregate(
        held,
        text,
        lambda done, word: F.regexp_replace(
            done, F.concat(F.lit(r"(?i)\s+"), word, F.lit(r"\s+")), F.concat(F.lit("\n"), word, F.lit(" "))
        ),
    )
    return strip(broken)


def distinct_warnings(df: DataFrame, message: str, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """One row per message: the first in the given order."""
    return drop_duplicate_rows(df, [message], order_by)


def distinct_factories(nodes: DataFrame, factory: str = "factory") -> DataFrame:
    """The simple class names that occur, sorted."""
    names = nodes.where((quoted(factory) != "")).select(simple_class(factory).alias("factory"))
    return names.distinct().orderBy("factory")
