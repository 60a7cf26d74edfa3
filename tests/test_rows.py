import pytest
from pyspark.sql import functions as F

from tablewright import (
    add_empty_rows,
    concat_tables,
    counter,
    date_range,
    drop_duplicate_rows,
    fill_missing,
    first_row,
    sort_rows,
    top_n,
)

from .fixtures import edge, edge_empty, hot, rows


def test_sort_puts_missing_last(spark):
    df = edge(spark)
    up = [r["x"] for r in sort_rows(df, "x").collect()]
    assert up[:4] == [-2.7, 2.5, 3.5, 3.5] and all(v is None or v != v for v in up[4:])
    down = [r["x"] for r in sort_rows(df, ["x", "k"], [False, True]).collect()]
    assert down[:4] == [3.5, 3.5, 2.5, -2.7]
    assert [r["g"] for r in sort_rows(df, "g", False).collect()] == ["g2", "g2", "g1", "g1", "g1", None]
    with pytest.raises(ValueError):
        sort_rows(df, ["x", "k"], [True])


def test_sort_spreads_a_hot_key_and_copies(spark):
    ids = spark.range(0, 60000, 1, 8)
    hot_key = ids.select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"), "id")
    copies = ids.select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"), F.lit("x").alias("t"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df, repeats in ((hot_key, False), (copies, True)):
            out = sort_rows(df, "k", copies=repeats)
            sizes = out.groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in sizes) == 60000 and max(r["count"] for r in sizes) < 15000
            keys = [r["k"] for r in out.collect()]
            assert keys == sorted(keys)
        assert sort_rows(hot_key, "k", copies=False).count() == 60000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_distinct(spark):
    df = edge(spark)
    assert drop_duplicate_rows(df).count() == 5
    assert drop_duplicate_rows(df, ["g"]).count() == 3
    kept = drop_duplicate_rows(hot(spark), ["key"], order_by="id")
    want = {}
    for key, _, i in sorted(((r["key"], 0, r["id"]) for r in hot(spark).collect()), key=lambda r: r[2]):
        want.setdefault(key, i)
    assert {r["key"]: r["id"] for r in kept.collect()} == want
    assert kept.columns == ["key", "value", "id"]


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("unique", [True, False])
def test_counter_unique_order(spark, ascending, unique):
    got = counter(hot(spark), "id", ascending=ascending, unique=unique).collect()
    ids = sorted((r["id"] for r in got), reverse=not ascending)
    assert [r["id"] for r in sorted(got, key=lambda r: r["counter"])] == ids
    assert sorted(r["counter"] for r in got) == list(range(1, 3001))


def test_counter_with_copies(spark):
    df = hot(spark).select("key", "value")
    got = counter(df, "key", name="i", start=0).collect()
    assert sorted(r["i"] for r in got) == list(range(3000))
    keys = [r["key"] for r in sorted(got, key=lambda r: r["i"])]
    present = [k for k in keys if k is not None]
    assert present == sorted(present) and keys[len(present):] == [None] * (3000 - len(present))
    copies = spark.range(250_001).select(F.lit("same").alias("t"))
    stats = counter(copies, "t").agg(F.count_distinct("counter"), F.min("counter"), F.max("counter")).first()
    assert tuple(stats) == (250_001, 1, 250_001)
    mapped = spark.range(10).select("id", F.create_map(F.lit("k"), "id").alias("m"), F.array("id").alias("a"))
    assert sorted(r["counter"] for r in counter(mapped, "id").collect()) == list(range(1, 11))
    assert sort_rows(mapped, "id", False).first()["id"] == 9
    assert counter(edge_empty(spark), "n").count() == 0
    assert counter(edge_empty(spark), "n", unique=True).count() == 0


def test_generated_rows(spark):
    df = add_empty_rows(edge(spark), 2)
    assert df.count() == 8 and df.where(" AND ".join(f"{c} IS NULL" for c in df.columns)).count() == 2
    days = [str(r["date"])[:10] for r in date_range(spark, "2024-02-28", "2024-03-01").orderBy("date").collect()]
    assert days == ["2024-02-28", "2024-02-29", "2024-03-01"]
    assert date_range(spark, "2024-02-02", "2024-02-01").count() == 0


def test_top(spark):
    df = edge(spark)
    assert [r["k"] for r in top_n(df, 2, ["n", "k"], [False, True]).collect()] == ["c", "d"]
    assert first_row(df, "x").first()["k"] == "c"


def test_fill(spark):
    out = fill_missing(edge(spark))
    assert out.where("x IS NULL OR isnan(x) OR n IS NULL").count() == 0
    assert out.where("k IS NULL").count() == 1
    assert fill_missing(edge(spark), "-").where("k = '-' OR g = '-' OR t = '-'").count() == 3
    assert fill_missing(edge(spark), {"k": "?", "n": 9}).where("k = '?' AND n = 9").count() == 1


def test_concat(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([("y", 2.5)], "name string, amount double")
    c = spark.createDataFrame([(10_000_000_000,)], "id bigint")
    out = concat_tables(a, b, c)
    assert out.dtypes == [("id", "bigint"), ("name", "string"), ("amount", "double")]
    assert rows(out) == sorted([(1, "x", None), (None, "y", 2.5), (10_000_000_000, None, None)], key=repr)
    assert concat_tables(a) is a
    mixed = concat_tables(a, spark.createDataFrame([("k",)], "id string"))
    assert {r["id"] for r in mixed.collect()} == {"1", "k"}


def test_copies_are_unfolded_once(spark):
    """Copies come next to each other; the plan places the rows once and unfolds them in one branch."""
    df = spark.createDataFrame([(1, "a")] * 1000 + [(2, "b")] * 16 + [(2, "c")] * 17 + [(3, None)], "k int, t string").repartition(7)
    got = counter(df, "k", ascending=False)
    numbers = {}
    for r in got.collect():
        numbers.setdefault((r["k"], r["t"]), []).append(r["counter"])
    assert {key: (min(n), max(n), len(set(n))) for key, n in numbers.items()} == {
        (3, None): (1, 1, 1), (2, "b"): (2, 17, 16), (2, "c"): (18, 34, 17), (1, "a"): (35, 1034, 1000),
    }
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Union" not in plan
