import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright import corpus as W, file_table, pack_files, read_packed, scan_docs, session, write_documents
from tablewright.plans import QUERIES
from tablewright.plans.documents import customer_files
from tablewright.plans.registry import Tables

HEAD = '<entry key="factory" type="xstring" value="org.sample.base.db.DBReaderNodeFactory"/>'


def entry(key, value):
    return f'<entry key="{key}" type="xstring" value="{value}"/>'


DOCS = {
    "Reader (#1)": HEAD + entry("statement", "SELECT a,%%00010 b FROM t WHERE a &lt; 3 &amp;&amp; b &gt; &quot;%%08364&quot;"),
    "Query (#12)": HEAD + entry("statement", "") + entry("query", "WITH q AS (TABLE t) TABLE q"),
    "Text (#3)": HEAD + entry("a", "select 1") + entry("b", "SELECT 22"),
    "Plain": "<config>\n  com.other.FilterNodeFactory$1\r\n</config>\n",
    "Google (#4)": "<config>org.other.GoogleApiConnectorFactory</config>",
    "By content": "<config>DatabaseConnectorNodeFactory</config>",
    "No node": "<config>nothing</config>",
}


@pytest.fixture
def docs(spark, tmp_path):
    for folder, content in DOCS.items():
        (tmp_path / "flow" / folder).mkdir(parents=True)
        (tmp_path / "flow" / folder / "settings.xml").write_text(content, encoding="utf-8")
    (tmp_path / "flow" / "other.xml").write_text("x")
    (tmp_path / "flow" / "Plain" / "bytes").mkdir()
    (tmp_path / "flow" / "Plain" / "bytes" / "settings.xml").write_bytes(b"ok\xff\xfe!")
    return scan_docs(spark, str(tmp_path))


def test_scan(docs):
    got = {r["path"].split("/flow/")[1]: r["content"] for r in docs.collect()}
    assert got.pop("Plain/bytes/settings.xml") == "ok!"
    assert got == {f"{k}/settings.xml": v for k, v in DOCS.items()}


def test_packed_files(spark, docs, tmp_path):
    """The packed table gives the same documents; later batches hold new and changed files only."""
    packed = str(tmp_path / "packed")
    files = {r["path"]: r["bytes"] for r in file_table(spark, str(tmp_path / "flow"), "settings.xml").collect()}
    assert len(files) == len(DOCS) + 1 and all(n > 0 for n in files.values())
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    assert pack_files(spark, str(tmp_path / "flow"), packed, "1")
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert not pack_files(spark, str(tmp_path / "flow"), packed, "1")
    want = lambda: sorted((r["path"].split("/flow/")[1], r["content"]) for r in docs.collect())
    got = lambda: sorted((r["path"].split("/flow/")[1], r["content"]) for r in read_packed(spark, packed).collect())
    assert got() == want()
    assert len(list((tmp_path / "packed" / "batches").glob("*/part-*"))) < len(files)
    (tmp_path / "flow" / "Late (#5)").mkdir()
    (tmp_path / "flow" / "Late (#5)" / "settings.xml").write_text("late")
    changed = tmp_path / "flow" / "Plain" / "settings.xml"
    changed.write_text("changed")
    os.utime(changed, (2_000_000_000, 2_000_000_000))
    spark.catalog.clearCache()
    assert pack_files(spark, str(tmp_path / "flow"), packed, "2")
    docs = scan_docs(spark, str(tmp_path / "flow"))
    assert got() == sorted((r["path"].split("/flow/")[1], r["content"]) for r in docs.collect())
    assert spark.read.parquet(f"{packed}/batches/*").count() == len(files) + 2


def test_documents_are_written_by_many_tasks(spark):
    """Few bytes in many files are not left to one task, and each row is one file in its folder."""
    t = Tables(spark, "/root/testdata/sf0.01")
    files = file_table(spark, customer_files(t), "*.txt").collect()
    names = [r["path"].rsplit("/", 2) for r in files]
    assert len(names) == 30 and {n[1] for n in names} == {f"part={i}" for i in range(25)}
    tasks = Counter(n[2].split("-")[1] for n in names)
    assert len(tasks) > 4 and max(tasks.values()) < 10


def test_documents_cost_few_files_and_folders(spark, tmp_path):
    """Equal documents are dealt evenly; no checksum files, and a task makes few folders."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.range(0, 1000).select((F.col("id") % 25).alias("place"), F.lit("same").alias("text"))
    write_documents(docs, str(tmp_path / "docs"), "place", "text")
    assert not list((tmp_path / "docs").rglob("*.crc"))
    files = [(f.parent.name, f.name.split("-")[1]) for f in (tmp_path / "docs").glob("place=*/part-*.txt")]
    assert len(files) == 1000 and len({folder for folder, _ in files}) == 25
    assert len(set(files)) <= tasks + 25
    assert max(Counter(task for _, task in files).values()) < 4 * max(1000 / tasks, 5)


def test_pack_query(spark, tmp_path, monkeypatch):
    """Its documents come from many tasks, and all are in the first of two batches."""
    monkeypatch.setitem(session._folders, spark.conf.get("spark.app.id"), str(tmp_path))
    packed = QUERIES["pack_files"](spark, "/root/testdata/sf0.01")
    assert packed.count() == 30
    assert len({f.name.split("-")[1] for f in tmp_path.glob("*-documents-*/part=*/part-*.txt")}) > 4
    batches = [spark.read.parquet(str(b)).count() for b in tmp_path.glob("*-packed-*/batches/*")]
    assert sorted(batches) == [0, 30]


def test_inventory(docs):
    got = {r["name"]: (r["factory"], r["sql"]) for r in W.node_inventory(docs).collect()}
    assert got == {
        "Reader": ("org.sample.base.db.DBReaderNodeFactory", 'SELECT a,\n b FROM t WHERE a < 3 && b > "€"'),
        "Query": ("org.sample.base.db.DBReaderNodeFactory", "WITH q AS (TABLE t) TABLE q"),
        "Text": ("org.sample.base.db.DBReaderNodeFactory", "SELECT 22"),
        "Plain": ("com.other.FilterNodeFactory$1", None),
        "Google": ("org.other.GoogleApiConnectorFactory", None),
        "By content": ("DatabaseConnectorNodeFactory", None),
    }


def test_sql_from_text(spark):
    df = spark.createDataFrame([("<x>select a\nfrom t where b</x>",), ("nothing",)], "content string")
    assert [r["sql"] for r in W.extract_sql(df, "content").collect()] == ["select a\nfrom t where", None]
    assert [r["sql"] for r in W.extract_sql(df, "content", search_text=False).collect()] == [None, None]


def python_decode(text):
    return re.sub(r"%%(\d{5})", lambda m: chr(int(m.group(1))), text)


@pytest.mark.parametrize("text", [
    "plain", "", "a%%00010b", "%%%00032x", "%%%%00032", "%%0003", "%%00037%00032", "%%00009%%00010", "é%%08364%%66304", "%%12", "100%%",
    "%%00037%%0003200032", "%%000%%0004810", "".join(f"%%{c:05d}" for c in range(60, 200)) + "%%00065x",
])
def test_decode(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(W.decode_escapes("t")).first()[0] == python_decode(text)


def test_decode_random(spark):
    rng = random.Random(2)
    parts = ["%%", "%", "00037", "00032", "0003", "%%00037", "%%00065", "%%55296", "%%64976", "\ufdd0", "a", "é", " ", "%%00000", "%%99999"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", W.decode_escapes("t").alias("d"))

    def want(text):
        return re.sub(r"%%(\d{5})", lambda m: m[0] if 0xD800 <= int(m[1]) < 0xE000 else chr(int(m[1])), text)

    assert [(r["t"], r["d"]) for r in df.collect() if r["d"] != want(r["t"])] == []


def test_encode_decode(spark):
    text = "é a%b\nc  d&"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    coded = df.select(W.encode_escapes("t", " é\n").alias("t"))
    assert coded.first()[0] == "%%00233%%00032a%b%%00010c%%00032%%00032d&"
    assert [r[0] for r in coded.select(W.decode_escapes("t")).collect()] == [text, None]


def test_entities(spark):
    df = spark.createDataFrame([("&amp;lt; &lt;a&gt; &#xA;&#x9;&#xD;&quot;",)], "t string")
    assert df.select(W.unescape_entities("t")).first()[0] == "&lt; <a> \n\t\r\""


def test_entries(spark):
    text = entry("a", " 1 ") + entry("b", "") + entry("a", "2") + entry("c", "<later>") + entry("d", "[Workflows edited x]") + entry("b", "3")
    df = spark.createDataFrame([(1, text), (2, entry("a", "9")), (3, "")], "i int, t string")
    got = sorted(tuple(r) for r in W.extract_entries(df, "t", "i").collect())
    assert got == [(1, "a", "1"), (2, "a", "9")]
    assert W.extract_entries(df, "t", "i", drop_placeholders=False).count() == 4
    plan = W.extract_entries(df, "t", "i")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("url, parts", [
    ("jdbc:mysql://h:3306/db", ("mysql", "h", 3306, "db")),
    ("jdbc:postgresql://h/db?x=1", ("postgresql", "h", None, "db")),
    ("jdbc:sybase:Tds:h:5000", ("sybase", "h", 5000, None)),
    ("jdbc:oracle:thin:@h:1521:sid", ("oracle", "@h", 1521, None)),
    ("jdbc:sqlserver://h:1433;databaseName=db", ("sqlserver", "h", 1433, "db")),
    ("jdbc:h2", (None, None, None, None)),
])
def test_jdbc_url(spark, url, parts):
    row = W.parse_jdbc_url(spark.createDataFrame([(url,)], "u string"), "u").first()
    assert (row["subprotocol"], row["host"], row["port"], row["database_name"]) == parts


def test_types(spark):
    df = spark.createDataFrame([("org.x.BigQueryDBConnectorNodeFactory", "com.Sybase.Driver"), ("Other", "other")], "f string, d string")
    got = [tuple(r) for r in df.select(W.factory_type("f"), W.driver_type("d")).collect()]
    assert got == [("bigquery", "sybase"), ("unknown", "jdbc")]


def test_hints(spark):
    sql = "/* INSTANCIA: srv1\n * BANCO DE DADOS: my db * */ SELECT * FROM `proj-1.d.t`"
    df = spark.createDataFrame([(sql, None, "x"), (sql, "", ""), ("SELECT 1", None, None)], "sql string, n string, d string")
    got = [(r["project_from_sql"], r["hint_instance"], r["hint_database"], r["project"]) for r in W.sql_hints(df, "sql", "n", "d").collect()]
    assert got == [("proj-1", "srv1", "my db", "x"), ("proj-1", "srv1", "my db", "proj-1"), (None, None, None, None)]


NODES = [
    ("n1", "org.a.Joiner", True, "Joiner_Wired"), ("n2", "org.a.Joiner", True, "GroupBy_Extracted"),
    ("n3", "b.StringManip", True, "StringManip_Deterministic"), ("n4", "b.StringManip", True, "Java_LLM"),
    ("n5", "Script", True, "PythonScript_Injected"), ("n6", "Script", True, "template"), ("n7", "", True, ""),
    ("a name of more than twenty-five characters", "x.Unknown1", False, ""), ("n9", "x.Unknown1", False, ""), ("n10", "x.Unknown2", False, ""),
]


def nodes(spark, rows=NODES):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, factory string, matched boolean, template string")


def test_figures(spark):
    df = nodes(spark)
    assert tuple(W.coverage_stats(df).first()) == (10, 7, 3, 70.0)
    assert tuple(W.coverage_stats(nodes(spark, [])).first()) == (0, 0, 0, 0.0)
    assert [tuple(r) for r in W.top_factories(df, n=3).collect()] == [("Joiner", 2), ("Script", 2), ("StringManip", 2)]
    assert {r["factory"] for r in W.top_factories(df).collect()} >= {"Unknown", "Unknown1"}
    assert [tuple(r)[1:] for r in W.method_distribution(df).collect()] == [
        ("Dedicado", 1, 10.0), ("Determinístico", 1, 10.0), ("Injeção Direta", 1, 10.0), ("LLM", 1, 10.0), ("Template", 3, 30.0), ("Fallback", 3, 30.0),
    ]
    assert [tuple(r) for r in W.fallback_groups(df, "i", sample_chars=25).collect()] == [
        ("Unknown1", "a name of more than twent", 2, "a name of more than twent... (2x)"), ("Unknown2", "n10", 1, "n10"),
    ]
    assert [r[0] for r in W.distinct_factories(df).collect()] == ["Joiner", "Script", "StringManip", "Unknown1", "Unknown2"]
    assert W.distinct_warnings(df, "factory", "i").count() == 6


def python_split(sql):
    for word in W.CLAUSES:
        sql = re.sub(rf"\s+({word})\s+", f"\n{word} ", sql, flags=re.IGNORECASE)
    return sql.strip()


@pytest.mark.parametrize("sql", [
    "select a from t left join u on t.a = u.a where b and c or d group by a order by a limit 3",
    " SELECT x FROM  y\nWHERE z ", "oronto and", "",
])
def test_clauses(spark, sql):
    df = spark.createDataFrame([(sql,)], "t string")
    assert df.select(W.split_clauses("t")).first()[0] == python_split(sql)


def test_clauses_random(spark):
    """Against one pass per keyword, with keywords side by side and parts of them."""
    rng = random.Random(6)
    words = [*W.CLAUSES, *[w.lower() for w in W.CLAUSES], "Or", "a", "t.x = 1", "LEFT", "GROUP", "BY", "land", "x" + W.MARK, ""]
    texts = []
    for _ in range(4000):
        chosen = [rng.choice(words) if rng.random() < 0.6 else "b" for _ in range(rng.randint(0, 9))]
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t ", ""]) for w in chosen))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", W.split_clauses("t").alias("s"))
    assert [(r["t"], r["s"]) for r in df.collect() if r["s"] != python_split(r["t"])] == []


def test_connection_info(spark):
    rows = [
        ("a", "org.x.MySQLDBConnectorNodeFactory" + entry("databaseUrl", "jdbc:mysql://h:3306/db") + entry("user", "u")),
        ("b", "org.x.JDBCConnectorNodeFactory" + entry("driver", "com.sybase.Driver") + entry("host", "own") + entry("url", "jdbc:sybase:Tds:h:5000")),
        ("c", "org.x.BigQueryDBConnectorNodeFactory" + entry("database", "proj") + entry("port", "99")),
        ("d", "org.x.DBLoaderNodeFactory" + entry("schema", "s") + entry("table", "t") + entry("driver", "&lt;none&gt;")),
        ("e", "org.x.DBReaderNodeFactory" + entry("statement", "SELECT 1 /* INSTANCIA: srv */") + entry("driver", "org.inner.X")),
        ("f", "org.x.JoinerNodeFactory"),
    ]
    df = spark.createDataFrame(rows, "path string, content string")
    got = {r["path"]: r for r in W.connection_info(df, internal="org.inner").collect()}
    assert sorted(got) == ["a", "b", "c", "d", "e"]
    assert [got[k]["db_type"] for k in "abcde"] == ["mysql", "sybase", "bigquery", "db_loader", "db_reader"]
    a, b, c, d = (got[k] for k in "abcd")
    assert (a["host"], a["port"], a["database_name"], a["user"], a["is_connector"]) == ("h", 3306, "db", "u", True)
    assert (b["host"], b["port"], b["subprotocol"]) == ("own", 5000, "sybase")
    assert (c["project"], c["port"], c["is_load"]) == ("proj", 99, False)
    assert (d["schema"], d["table"], d["is_load"], d["is_connector"]) == ("s", "t", True, False)
    assert got["e"]["hint_instance"] == "srv" and got["e"]["driver"] is None


def test_connection_entries(spark):
    rows = [
        ("a", "org.x.DBLoaderNodeFactory" + entry("database", "d") + entry("batch_size", "500") + entry("if_exists", " append ")),
        ("b", "org.x.JDBCConnectorNodeFactory" + entry("host", "org.inner.Host") + entry("role", "first") + entry("role", "second")),
        ("c", "org.x.JDBCConnectorNodeFactory" + entry("host", "<none>") + entry("db_type", "oracle") + entry("timeout", "soon")
         + entry("port_object_summary", "org.inner.Y")),
        ("d", "org.x.JDBCConnectorNodeFactory" + entry("user", "") + entry("userName", "u") + entry("project_id", "p")),
    ]
    df = spark.createDataFrame(rows, "path string, content string")
    got = {r["path"]: r for r in W.connection_info(df, internal="org.inner").collect()}
    assert (got["a"]["project"], got["a"]["batch_size"], got["a"]["if_exists"]) == ("d", 500, "append")
    assert (got["b"]["host"], got["b"]["role"]) == (None, "first")
    c = got["c"]
    assert (c["host"], c["db_type"], c["timeout"], c["port_object_summary"]) == (None, "oracle", None, "org.inner.Y")
    assert (got["d"]["user"], got["d"]["project"]) == ("u", "p")


def test_node_list(spark):
    rows = [("a name that is long", "Java_LLM", True), ("b", "x", False), ("c", "Joiner_Wired", True), (None, "", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, template string, matched boolean")
    df = df.withColumn("factory", F.concat(F.lit("f"), "i")).repartition(3)
    got = [tuple(r) for r in W.node_list(df, "i", name_width=6).orderBy("number").collect()]
    assert got == [
        (1, "a name", "f0", "LLM (Java_LLM)", "| 1 | a name | f0 | LLM (Java_LLM) |"),
        (2, "c", "f2", "Dedicado (Joiner_Wired)", "| 2 | c | f2 | Dedicado (Joiner_Wired) |"),
        (3, None, "f3", "Template", "| 3 |  | f3 | Template |"),
        (4, "b", "f1", "Fallback", "| 4 | b | f1 | Fallback |"),
    ]


def test_node_methods(spark):
    rows = [("a", "Java_LLM", True), ("b", "Joiner_Wired", True), ("c", "", True), ("d", None, True), ("e", "Java_LLM", False)]
    df = spark.createDataFrame(rows, "name string, template string, matched boolean")
    got = {r["name"]: (r["method"], r["special"], r["kind"]) for r in W.node_methods(df, "name").collect()}
    assert got == {
        "a": ("LLM (Java_LLM)", "Java_LLM", "Java Snippet (LLM)"),
        "b": ("Dedicado (Joiner_Wired)", None, None),
        "c": ("Template", None, None),
        "d": ("Template", None, None),
        "e": ("Fallback", None, None),
    }
