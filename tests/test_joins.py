import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright import join_by_flags, join_tables, query_by_keys

from .fixtures import edge, edge_empty, hot_rows, right_side


def bag(frame: pd.DataFrame):
    cells = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(r) for r in cells.itertuples(index=False)), key=repr)


@pytest.fixture(params=["10MB", "-1"])
def broadcast(spark, request):
    """Both ways: small sides broadcast, and the shuffled composition for large ones."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def sides(spark):
    left = [(k, v, i) for k, v, i in hot_rows(60, 1)]
    right = [(k, i) for k, _, i in hot_rows(20, 2) if k not in (5, 6)] + [(77, 100)]
    a = spark.createDataFrame(left, "key bigint, value double, id bigint")
    b = spark.createDataFrame(right, "key bigint, id bigint")
    pa = pd.DataFrame(left, columns=["key", "value", "id"]).astype({"key": "Int64"})
    pb = pd.DataFrame(right, columns=["key", "id"]).astype({"key": "Int64"})
    return a, b, pa, pb


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_like_pandas(spark, broadcast, how):
    a, b, pa, pb = sides(spark)
    got = join_tables(a, b, "key", how=how)
    want = pa.merge(pb, on="key", how=how)
    assert got.columns == list(want.columns) == ["key", "value", "id_x", "id_y"]
    assert bag(got.toPandas().astype({"key": "Int64"})) == bag(want)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_different_names(spark, broadcast, how):
    a, b, pa, pb = sides(spark)
    got = join_tables(a, b.withColumnRenamed("key", "other"), "key", "other", how)
    want = pa.merge(pb.rename(columns={"key": "other"}), left_on="key", right_on="other", how=how)
    assert got.columns == list(want.columns)
    assert bag(got.toPandas().astype({"key": "Int64", "other": "Int64"})) == bag(want)


def test_missing_keys_can_stay_apart(spark, broadcast):
    left, right = edge(spark).select("k", "n"), right_side(spark)
    assert {r["k"] for r in join_tables(left, right, "k").collect()} == {"a", "b", None}
    assert {r["k"] for r in join_tables(left, right, "k", null_safe=False).collect()} == {"a", "b"}


def test_flags(spark, broadcast):
    left, right = edge(spark).select("k", "x"), right_side(spark)
    got = join_by_flags(left, right, "k", matches=False, left_unmatched=True, right_unmatched=True)
    assert got.columns == ["k", "x_x", "x_y"]
    assert sorted((r["k"], r["x_y"]) for r in got.collect()) == [("c", None), ("d", None), ("z", 40.0)]
    assert join_by_flags(left, right, "k", matches=False).count() == 0
    matched = join_by_flags(left, right, "k")
    anti = join_by_flags(left, right, "k", matches=False, left_unmatched=True)
    whole = join_by_flags(left, right, "k", left_unmatched=True)
    assert matched.count() + anti.count() == whole.count()


def test_natural_and_errors(spark):
    left, right = edge(spark), right_side(spark)
    assert join_tables(left, right).columns == left.columns
    with pytest.raises(ValueError):
        join_tables(left, right.toDF("p", "q"))
    with pytest.raises(ValueError):
        join_tables(left, right, "k", how="cross")
    with pytest.raises(ValueError):
        join_tables(left, left, "k", suffixes=("", ""))


def test_self_join(spark):
    df = edge(spark).where("k IS NOT NULL").dropDuplicates()
    out = join_tables(df, df, "k")
    assert out.columns[:3] == ["k", "g_x", "n_x"] and out.count() == 4


def test_no_nested_loop(spark):
    plan = join_tables(edge(spark), right_side(spark), "k", how="outer")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("how, shuffles", [("left", 3), ("outer", 4)])
def test_shuffles(spark, how, shuffles):
    """The rows without a partner use the shuffles of the inner join again."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        out = join_tables(read("orders"), read("customer"), "o_custkey", "c_custkey", how=how)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert len(lines) == shuffles


def test_hot_key_is_split(spark):
    """The join of a key with a third of all rows runs in several tasks, for outer joins too."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(0, 30000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("key"), "id", F.rand(1).alias("r")
        )
        dims = spark.range(1000).select(F.col("id").alias("key"), F.lit("d").alias("name"))
        out = join_tables(dims, facts, "key", how="left")
        assert out.count() == 30000 + 3
        out = join_tables(dims, facts, "key", how="left")
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_query_by_keys(spark):
    out = query_by_keys(edge(spark), right_side(spark), "k")
    assert sorted(r["k"] for r in out.collect()) == ["a", "b", "b"]
