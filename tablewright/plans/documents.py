"""Queries for text extraction over documents."""

from pyspark.sql import functions as F

from ..operators import corpus as W
from ..session import new_path
from ..sources.files import pack_files, read_packed, scan_docs, write_documents
from .registry import query

ATTRIBUTE = r'(href|class|id|lang|charset)="([^"]*)"'


@query(
    "entry_extract",
    "SELECT page_id, key, trim(value) AS value FROM (SELECT page_id, key, arg_min(value, pos) AS value FROM (SELECT page_id,"
    f" unnest(regexp_extract_all(html, '{ATTRIBUTE}', 1)) AS key, unnest(regexp_extract_all(html, '{ATTRIBUTE}', 2)) AS value,"
    f" unnest(range(len(regexp_extract_all(html, '{ATTRIBUTE}')))) AS pos FROM pages) GROUP BY page_id, key) WHERE trim(value) <> ''",
)
def _(t):
    return W.extract_entries(t.pages, "html", "page_id", ATTRIBUTE, drop_placeholders=False)


@query(
    "first_nonempty_pattern",
    "SELECT page_id, coalesce(nullif(regexp_extract(html, '<h2>([^<]*)</h2>', 1), ''),"
    " nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '') AS head FROM pages",
)
def _(t):
    head = W.first_nonempty_pattern("html", ["<h2>([^<]*)</h2>", "<h1>([^<]*)</h1>", "<title>([^<]*)</title>"])
    return t.pages.select("page_id", F.coalesce(head, F.lit("")).alias("head"))


@query("decode_escapes", "SELECT doc_id, text FROM documents")
def _(t):
    coded = W.encode_escapes("text", " éaê\n")
    return t.documents.select("doc_id", coded.alias("text")).select("doc_id", W.decode_escapes("text").alias("text"))


ENTITIES_SQL = (
    "replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),"
    " '&quot;', '\"'), '&#xA;', chr(10)), '&#xD;', chr(13)), '&#x9;', chr(9))"
)


@query("unescape_entities", f"SELECT page_id, {ENTITIES_SQL.format('html')} AS html FROM pages")
def _(t):
    return t.pages.select("page_id", W.unescape_entities("html").alias("html"))


@query(
    "url_parts",
    "SELECT page_id, CAST(NULL AS VARCHAR) AS subprotocol, regexp_extract(url, '//([^:/]+):?(\\d+)?/?([^;?]*)', 1) AS host,"
    " TRY_CAST(nullif(regexp_extract(url, '//([^:/]+):?(\\d+)?/?([^;?]*)', 2), '') AS BIGINT) AS port,"
    " nullif(regexp_extract(url, '//([^:/]+):?(\\d+)?/?([^;?]*)', 3), '') AS database_name FROM pages",
)
def _(t):
    df = W.parse_jdbc_url(t.pages.select("page_id", "url"), "url")
    return df.select("page_id", "subprotocol", "host", "port", "database_name")


@query(
    "jdbc_url_parts",
    "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'sybase' ELSE 'sqlserver' END AS subprotocol,"
    " 'host' || s_nationkey AS host, 1000 + s_suppkey AS port, CASE s_suppkey % 3 WHEN 1 THEN NULL ELSE 'db' || s_suppkey END AS database_name FROM supplier",
)
def _(t):
    url = F.expr(
        "CASE s_suppkey % 3"
        " WHEN 0 THEN concat('jdbc:mysql://host', s_nationkey, ':', 1000 + s_suppkey, '/db', s_suppkey, '?ssl=true')"
        " WHEN 1 THEN concat('jdbc:sybase:Tds:host', s_nationkey, ':', 1000 + s_suppkey)"
        " ELSE concat('jdbc:sqlserver://host', s_nationkey, ':', 1000 + s_suppkey, ';databaseName=db', s_suppkey) END"
    )
    df = W.parse_jdbc_url(t.supplier.select("s_suppkey", url.alias("url")), "url")
    return df.select("s_suppkey", "subprotocol", "host", "port", "database_name")


@query(
    "classify_fragment",
    "SELECT p_partkey, CASE WHEN p_type LIKE '%ECO%' THEN 'cheap' WHEN p_type LIKE '%M%' THEN 'with m' ELSE 'unknown' END AS kind FROM part",
)
def _(t):
    return t.part.select("p_partkey", W.classify_by_fragment("p_type", [("ECO", "cheap"), ("M", "with m")]).alias("kind"))


@query(
    "driver_type",
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'mysql' WHEN 1 THEN 'mssql' WHEN 2 THEN 'postgres' ELSE 'jdbc' END AS driver,"
    " CASE p_size % 4 WHEN 0 THEN 'db_reader' WHEN 1 THEN 'bigquery' WHEN 2 THEN 'mysql' ELSE 'unknown' END AS factory FROM part",
)
def _(t):
    by_size = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p_size") % 4 + 1)
    driver = by_size("com.MySQL.Driver", "net.jtds.Driver", "org.postgresql.Driver", "org.other.Driver")
    factory = by_size("DBReaderNodeFactory", "BigQueryDBConnectorNodeFactory", "MySQLDBConnectorNodeFactory", "Joiner")
    return t.part.select("p_partkey", W.driver_type(driver).alias("driver"), W.factory_type(factory).alias("factory"))


def settings_docs(t):
    """One settings document per part: a statement, a query, a bare text or no SQL."""
    start = "concat('<config key=\"model\"><entry key=\"factory\" type=\"xstring\" value=\"org.sample.', p_type, 'NodeFactory\"/>',"
    content = F.expr(
        "CASE p_size % 4 WHEN 0 THEN " + start +
        " '<entry key=\"statement\" type=\"xstring\" value=\"SELECT *%%00010FROM t WHERE k &lt; ', p_partkey, '\"/><!-- DBReader --></config>')"
        " WHEN 1 THEN " + start +
        " '<entry key=\"statement\" type=\"xstring\" value=\"\"/><entry key=\"query\" type=\"xstring\" value=\"WITH x AS (TABLE t) SELECT ', p_partkey, '\"/><!-- DBReader --></config>')"
        " WHEN 2 THEN " + start +
        " '<entry key=\"a\" value=\"select 1\"/><entry key=\"b\" value=\"SELECT ', p_partkey, ' &amp;amp; 1\"/><!-- DBReader --></config>')"
        " ELSE " + start + " '<entry key=\"note\" value=\"none\"/></config>') END"
    )
    path = F.expr("concat('/flow/', p_name, ' (#', p_partkey, ')/settings.xml')")
    return t.part.select("p_partkey", path.alias("path"), content.alias("content"))


SETTINGS_SQL = (
    "CASE p_size % 4 WHEN 0 THEN 'SELECT *' || chr(10) || 'FROM t WHERE k < ' || p_partkey"
    " WHEN 1 THEN 'WITH x AS (TABLE t) SELECT ' || p_partkey WHEN 2 THEN 'SELECT ' || p_partkey || ' &amp; 1' END"
)


def customer_files(t) -> str:
    """Folder of settings files of two lines, one for each 50 customers, dealt to 25 folders."""
    blocks = t.customer.groupBy(F.expr("c_custkey div 50").alias("block")).agg(
        F.format_string('<config n="%d"\n top="%s"/>', F.count("*"), F.max("c_name")).alias("value")
    )
    path = new_path(t.spark, "documents")
    write_documents(blocks.select(F.expr("block % 25").alias("part"), "value"), path, "part")
    return path


CUSTOMER_FILES = (
    "SELECT 'part=' || block % 25 AS folder, '<config n=\"' || count(*) || '\"' || chr(10) || ' top=\"' || max(c_name) || '\"/>' || chr(10)"
    " AS content FROM (SELECT *, c_custkey // 50 AS block FROM customer) GROUP BY block"
)


@query("scan_docs", CUSTOMER_FILES)
def _(t):
    """As many documents as the table grows by, read with their paths."""
    docs = scan_docs(t.spark, customer_files(t), "*.txt")
    return docs.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "content")


@query("pack_files", CUSTOMER_FILES)
def _(t):
    """The same documents, packed once; the second batch finds nothing new."""
    root, packed = customer_files(t), new_path(t.spark, "packed")
    for batch in ("first", "second"):
        pack_files(t.spark, root, packed, batch, "*.txt")
    docs = read_packed(t.spark, packed)
    return docs.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "content")


@query("extract_sql", f"SELECT p_partkey, {SETTINGS_SQL} AS sql FROM part")
def _(t):
    return W.extract_sql(settings_docs(t), "content").select("p_partkey", "sql")


@query(
    "node_inventory",
    "SELECT '/flow/' || p_name || ' (#' || p_partkey || ')/settings.xml' AS path, p_name AS name,"
    f" 'org.sample.' || p_type || 'NodeFactory' AS factory, {SETTINGS_SQL} AS sql FROM part",
)
def _(t):
    return W.node_inventory(settings_docs(t))


@query(
    "sql_hints",
    "SELECT c_custkey, 'proj-' || c_nationkey AS project_from_sql, 'srv' || c_custkey AS hint_instance, c_mktsegment AS hint_database,"
    " CASE WHEN c_nationkey % 2 = 0 THEN 'main' ELSE 'proj-' || c_nationkey END AS project FROM customer",
)
def _(t):
    sql = F.expr(
        "concat('/* INSTANCIA: srv', c_custkey, '\\n * BANCO DE DADOS: ', c_mktsegment, ' \\n */ SELECT 1 FROM `proj-', c_nationkey, '.d.t`')"
    )
    df = t.customer.select("c_custkey", sql.alias("sql"), F.when(F.col("c_nationkey") % 2 == 0, "main").otherwise("").alias("named"))
    return W.sql_hints(df, "sql", "named").drop("sql", "named")


CONNECTION_SQL = {
    "path": "'/c/' || c_custkey",
    "factory": "['MySQLDBConnectorNodeFactory', 'JDBCConnectorNodeFactory', 'BigQueryDBConnectorNodeFactory', 'DBLoaderNodeFactory',"
    " 'DBReaderNodeFactory'][kind + 1]",
    "db_type": "['mysql', 'postgres', 'bigquery', 'db_loader', 'oracle'][kind + 1]",
    "is_connector": "kind < 3",
    "is_load": "kind = 3",
    "jdbc_url": "CASE kind WHEN 0 THEN 'jdbc:mysql://h' || c_nationkey || ':' || (1000 + c_nationkey) || '/' || c_mktsegment"
    " WHEN 1 THEN 'jdbc:postgresql://h' || c_nationkey || ':' || (1000 + c_nationkey) || '/' || c_mktsegment END",
    "subprotocol": "CASE kind WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' END",
    "host": "CASE WHEN kind < 2 THEN 'h' || c_nationkey WHEN kind = 4 THEN 'own' END",
    "port": "CASE WHEN kind < 2 THEN CAST(1000 + c_nationkey AS BIGINT) WHEN kind = 4 THEN 77 END",
    "database_name": "CASE WHEN kind < 2 THEN c_mktsegment END",
    "driver": "CASE kind WHEN 1 THEN 'org.postgresql.Driver' WHEN 4 THEN 'oracle.jdbc.Driver' END",
    "user": "CASE kind WHEN 0 THEN 'u' || c_custkey WHEN 4 THEN 'v' || c_custkey END",
    "schema": "CASE kind WHEN 3 THEN 's' || c_nationkey END",
    "table": "CASE kind WHEN 3 THEN 't' || c_custkey END",
    "project": "CASE WHEN kind IN (2, 3) THEN c_mktsegment WHEN kind = 4 THEN 'p' || c_nationkey END",
    "hint_instance": "CASE kind WHEN 4 THEN 'srv' || c_custkey END",
    "hint_database": "NULL::VARCHAR",
    "database": "CASE WHEN kind IN (2, 3) THEN c_mktsegment END",
    "batch_size": "CASE kind WHEN 3 THEN CAST(c_custkey AS BIGINT) END",
    "if_exists": "CASE kind WHEN 3 THEN 'append' END",
    "warehouse": "CASE kind WHEN 4 THEN 'w' || c_nationkey END",
    "project_id": "CASE kind WHEN 4 THEN 'p' || c_nationkey END",
    "url": "CASE kind WHEN 1 THEN 'jdbc:postgresql://h' || c_nationkey || ':' || (1000 + c_nationkey) || '/' || c_mktsegment END",
}
OTHER_KEYS = {
    "db_dialect": "VARCHAR", "db_driver": "VARCHAR", "catalog": "VARCHAR", "credential": "VARCHAR", "auth_type": "VARCHAR",
    "service_account_email": "VARCHAR", "key_file_location": "VARCHAR", "dataset": "VARCHAR",
    "location": "VARCHAR", "region": "VARCHAR", "role": "VARCHAR", "account": "VARCHAR", "instance": "VARCHAR",
    "timeout": "BIGINT", "connection_timeout": "BIGINT", "query_timeout": "BIGINT", "server": "VARCHAR",
    "server_name": "VARCHAR", "sid": "VARCHAR", "service_name": "VARCHAR", "insert_mode": "VARCHAR",
    "port_object_summary": "VARCHAR",
}


@query(
    "connection_info",
    "SELECT "
    + ", ".join(f'{sql} AS "{name}"' for name, sql in CONNECTION_SQL.items())
    + "".join(f', NULL::{kind} AS "{name}"' for name, kind in OTHER_KEYS.items())
    + " FROM (SELECT *, c_nationkey % 5 AS kind FROM customer)",
)
def _(t):
    """A connector with an address, one with a driver, one to a project, a loader and a reader."""
    entry = lambda key, value: f"""<entry key="{key}" type="xstring" value="', {value}, '"/>"""
    address = "'://h', c_nationkey, ':', 1000 + c_nationkey, '/', c_mktsegment"
    content = F.expr(
        "CASE c_nationkey % 5"
        f" WHEN 0 THEN concat('org.sample.MySQLDBConnectorNodeFactory {entry('databaseUrl', "'jdbc:mysql', " + address)}"
        f"{entry('userName', "' u', c_custkey")}{entry('user', "''")}')"
        f" WHEN 1 THEN concat('org.sample.JDBCConnectorNodeFactory {entry('driver', "'org.postgresql.Driver'")}"
        f"{entry('driver', "'com.mysql.Driver'")}{entry('url', "'jdbc:postgresql', " + address)}{entry('host', "'<none>'")}')"
        f" WHEN 2 THEN concat('org.sample.BigQueryDBConnectorNodeFactory {entry('database', 'c_mktsegment')}')"
        f" WHEN 3 THEN concat('org.sample.DBLoaderNodeFactory {entry('database', 'c_mktsegment')}{entry('schema', "'s', c_nationkey")}"
        f"{entry('table', "'t', c_custkey")}{entry('batch_size', 'c_custkey')}{entry('if_exists', "'append'")}{entry('host', "'org.sample.inner.X'")}')"
        f" ELSE concat('org.sample.DBReaderNodeFactory {entry('driver', "'oracle.jdbc.Driver'")}{entry('host', "'own'")}{entry('port', "'77'")}"
        f"{entry('user', "'v', c_custkey")}{entry('warehouse', "'w', c_nationkey")}{entry('project_id', "'p', c_nationkey")}"
        f"{entry('statement', "'SELECT 1 /* INSTANCIA: srv', c_custkey, ' */'")}') END"
    )
    docs = t.customer.select(F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("path"), content.alias("content"))
    return W.connection_info(docs, internal="org.sample.inner")


def event_nodes(t):
    """One node per event: error events are unmatched, the others carry a template label."""
    return t.events.select(
        "event_id",
        F.concat(F.lit("node "), F.col("user_id").cast("string"), F.lit(" of a long settings folder")).alias("name"),
        F.concat(F.lit("org.sample."), "event_type", (F.col("user_id") % 3).cast("string")).alias("factory"),
        (F.col("event_type") != "error").alias("matched"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("Joiner_Wired", "StringManip_Deterministic", "Java_LLM", "PythonScript_Injected", "template", "GroupBy_Extracted", "")]),
            (F.col("user_id") % 7 + 1).cast("int"),
        ).alias("template"),
    )


@query(
    "coverage_stats",
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS matched,"
    " CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS fallback,"
    " round_even(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 1) AS coverage FROM events",
)
def _(t):
    return W.coverage_stats(event_nodes(t))


@query(
    "top_counts",
    "SELECT event_type || user_id % 3 AS factory, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY ALL ORDER BY count DESC, factory LIMIT 10",
)
def _(t):
    return W.top_factories(event_nodes(t), n=10)


@query(
    "method_share",
    "SELECT CAST(list_position(['Dedicado', 'Determinístico', 'Injeção Direta', 'LLM', 'Template', 'Fallback'], method) AS BIGINT) AS position,"
    " method, CAST(count(*) AS BIGINT) AS count, round_even(100.0 * count(*) / (SELECT count(*) FROM events), 1) AS pct FROM"
    " (SELECT CASE WHEN event_type = 'error' THEN 'Fallback' ELSE ['Dedicado', 'Determinístico', 'LLM', 'Injeção Direta', 'Template', 'Template', 'Template'][user_id % 7 + 1]"
    " END AS method FROM events) GROUP BY method",
)
def _(t):
    return W.method_distribution(event_nodes(t))


@query(
    "fallback_groups",
    "SELECT factory, sample, count, CASE WHEN count > 1 THEN sample || '... (' || count || 'x)' ELSE sample END AS cell FROM"
    " (SELECT event_type || user_id % 3 AS factory, CAST(count(*) AS BIGINT) AS count,"
    " substr(arg_min('node ' || user_id || ' of a long settings folder', event_id), 1, 25) AS sample FROM events WHERE event_type = 'error' GROUP BY ALL)",
)
def _(t):
    return W.fallback_groups(event_nodes(t), "event_id", sample_chars=25)


NODE_METHODS = (
    "SELECT event_id, name, factory, CASE WHEN event_type = 'error' THEN 'Fallback' ELSE [template, 'Determinístico (' || template || ')',"
    " 'LLM (' || template || ')', 'Injeção Direta', 'Template', template, 'Template'][kind + 1] END AS method, special,"
    " CASE special WHEN 'StringManip_Deterministic' THEN 'StringManipulation' WHEN 'Java_LLM' THEN 'Java Snippet (LLM)'"
    " WHEN 'PythonScript_Injected' THEN 'Python2Script' END AS kind, CASE special WHEN 'StringManip_Deterministic' THEN"
    " 'Expressão → .apply(lambda)' WHEN 'Java_LLM' THEN 'Código Java → LLM → pandas' WHEN 'PythonScript_Injected' THEN"
    " 'Código Python extraído e injetado' END AS translation FROM (SELECT event_id, event_type, kind,"
    " 'node ' || user_id || ' of a long settings folder' AS name, 'org.sample.' || event_type || user_id % 3 AS factory,"
    " CASE WHEN kind IN (0, 5) THEN 'Dedicado (' || label || ')' ELSE label END AS template,"
    " CASE WHEN event_type <> 'error' AND kind IN (1, 2, 3) THEN label END AS special FROM (SELECT *, user_id % 7 AS kind,"
    " ['Joiner_Wired', 'StringManip_Deterministic', 'Java_LLM', 'PythonScript_Injected', 'template', 'GroupBy_Extracted', '']"
    "[user_id % 7 + 1] AS label FROM events))"
)


@query(
    "node_methods",
    NODE_METHODS,
)
def _(t):
    return W.node_methods(event_nodes(t), ["event_id", "name", "factory"])


@query(
    "node_list",
    "SELECT number, name, factory, method, '| ' || number || ' | ' || name || ' | ' || factory || ' | ' || method || ' |' AS line FROM"
    " (SELECT row_number() OVER (ORDER BY method = 'Fallback', event_id) AS number, substr(name, 1, 12) AS name, factory, method"
    f" FROM ({NODE_METHODS}))",
)
def _(t):
    return W.node_list(event_nodes(t), "event_id", name_width=12)


@query("distinct_factories", "SELECT DISTINCT event_type || user_id % 3 AS factory FROM events")
def _(t):
    return W.distinct_factories(event_nodes(t))


@query(
    "distinct_warnings",
    "SELECT min(event_id) AS event_id, 'warn ' || props AS message FROM events GROUP BY props",
)
def _(t):
    df = t.events.select("event_id", F.concat(F.lit("warn "), "props").alias("message"))
    return W.distinct_warnings(df, "message", "event_id")


def _clauses_sql(text: str) -> str:
    for word in W.CLAUSES:
        text = f"regexp_replace({text}, '\\s+{word}\\s+', chr(10) || '{word} ', 'gi')"
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


@query("split_clauses", f"SELECT doc_id, {_clauses_sql('text')} AS sql FROM documents")
def _(t):
    return t.documents.select("doc_id", W.split_clauses("text").alias("sql"))
