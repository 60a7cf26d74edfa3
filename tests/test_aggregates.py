import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright import (
    aggregate_columns,
    append_sketches,
    distinct_bound,
    distinct_sketches,
    estimate_distinct,
    group_by,
    list_pieces,
    merge_sketches,
    read_sketches,
)
from tablewright.operators import selection

from .fixtures import edge, edge_empty, hot, hot_rows, rows


def frame():
    return pd.DataFrame(hot_rows(3000), columns=["key", "value", "id"]).astype({"key": "Int64"})


METHODS = {
    "Sum": "sum", "Mean": "mean", "Count": "count", "Min": "min", "Max": "max", "Median": "median",
    "Standard Deviation": "std", "Variance": "var", "Unique count": "nunique",
    "Mode": lambda x: x.mode().iloc[0],
}


@pytest.mark.parametrize("method", METHODS)
def test_like_pandas(spark, method):
    got = group_by(hot(spark), "key", {"value": method}).toPandas().sort_values("key")
    want = frame().groupby("key").agg({"value": METHODS[method]}).reset_index()
    assert list(got.columns) == ["key", "value"]
    assert list(got["key"]) == list(want["key"])
    np.testing.assert_allclose(got["value"].astype(float), want["value"].astype(float))


def test_several_methods_at_once(spark):
    got = group_by(hot(spark).withColumnRenamed("id", "n"), ["key"], {"value": "median", "n": "Sum_V2.5.2"})
    want = frame().groupby("key").agg({"value": "median", "id": "sum"}).reset_index()
    got = got.toPandas().sort_values("key")
    np.testing.assert_allclose(got["value"], want["value"])
    assert list(got["n"]) == list(want["id"])


@pytest.mark.parametrize("method", ["first", "last"])
def test_edges_by_order(spark, method):
    got = group_by(hot(spark), "key", {"value": method}, order_by="id").toPandas().sort_values("key")
    want = frame().sort_values("id").groupby("key").agg({"value": method}).reset_index()
    np.testing.assert_allclose(got["value"], want["value"])


def test_missing_groups_and_values(spark):
    df = edge(spark)
    got = {r["g"]: r["x"] for r in group_by(df, "g", {"x": "sum"}).collect()}
    assert got == {"g1": 9.5, "g2": 0.0}
    got = {r["g"]: r["x"] for r in group_by(df, "g", {"x": "max"}, keep_null_keys=True).collect()}
    assert got == {"g1": 3.5, "g2": None, None: -2.7}
    got = {r["g"]: r["x"] for r in group_by(df, "g", {"x": "median"}, keep_null_keys=True).collect()}
    assert got == {"g1": 3.5, "g2": None, None: -2.7}


def test_medians_and_modes_together(spark):
    got = group_by(hot(spark), "key", {"value": "median", "id": "mode"}, keep_null_keys=True).toPandas()
    want = frame().groupby("key", dropna=False).agg({"value": "median", "id": "min"}).reset_index()
    got, want = (f.astype({"key": "Int64"}).sort_values("key") for f in (got, want))
    np.testing.assert_allclose(got["value"], want["value"])
    assert list(got["id"]) == list(want["id"])


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (1, 3), (1, 2), (2, None)], "k int, v int")
    assert sorted(tuple(r) for r in group_by(df, "k", {"v": "mode"}).collect()) == [(1, 2), (2, None)]


def test_no_methods_and_no_keys(spark):
    df = edge(spark)
    first = {r["g"]: r["t"] for r in group_by(df.where("n > 0 OR t = 'x'"), "g", order_by="d").collect()}
    assert first["g1"] == "12"
    assert group_by(df, []).count() == 6
    row = group_by(df, [], {"x": "median", "n": "mode", "k": "nunique"}).first()
    assert (row["x"], row["n"], row["k"]) == (3.0, 2, 4)
    assert aggregate_columns(df, "max").first().asDict() == {"n": 3, "x": 3.5}
    assert aggregate_columns(df.select("x"), "median").first()["x"] == 3.0


def test_empty(spark):
    df = edge_empty(spark)
    assert group_by(df, "g", {"x": "median", "n": "sum"}).count() == 0
    assert group_by(df, [], {"x": "median", "n": "sum"}).first().asDict() == {"x": None, "n": 0}


def test_unknown_method_and_list(spark):
    with pytest.raises(ValueError):
        group_by(edge(spark), "g", {"x": "geometric mean"})
    with pytest.raises(ValueError, match="list_pieces"):
        group_by(edge(spark), "g", {"x": "List"})


def test_list_pieces_are_the_whole_list(spark):
    got = list_pieces(hot(spark), "key", "value", "id", piece_rows=100).collect()
    assert max(len(r["value"]) for r in got) == 100
    lists = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        lists.setdefault(r["key"], []).extend(r["value"])
    want = frame().sort_values("id").groupby("key")["value"].agg(list)
    assert set(lists) == set(want.index)
    for key, values in lists.items():
        assert [v for v in values if v is not None] == [v for v in want[key] if v == v]
        assert [v is None for v in values] == [v != v for v in want[key]]


def values_of(spark, groups):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "k string, v double").repartition(6)


def test_medians_of_hot_groups(spark, monkeypatch):
    """Several passes: brackets of many values, heavy values, ties on both sides of the middle."""
    monkeypatch.setattr(selection, "FEW", 20)
    monkeypatch.setattr(selection, "ACCURACY", 50)
    rng = random.Random(4)
    groups = {
        "wide": [rng.expovariate(1) * 10 ** rng.randint(-20, 20) for _ in range(9001)],
        "even": [rng.gauss(0, 1) for _ in range(8000)],
        "one value": [7.25] * 3000,
        "two values": [1.0] * 1500 + [2.0] * 1500,
        "two, uneven": [1.0] * 1501 + [2.0] * 1500,
        "half infinite": [float("inf")] * 700 + [float("-inf")] * 699 + [0.0],
        "few": [3.0, 1.0],
        None: list(range(500)),
    }
    df = values_of(spark, groups)
    want = {k: statistics.median(vs) for k, vs in groups.items()}
    got = {r["k"]: r["v"] for r in group_by(df, "k", {"v": "median"}, keep_null_keys=True).collect()}
    assert got == want
    for k, vs in groups.items():
        one = df.where(df["k"].eqNullSafe(k)).drop("k")
        assert group_by(one, [], {"v": "median"}).first()["v"] == want[k]
    empty = df.withColumn("v", F.lit(None).cast("double"))
    assert {r["v"] for r in group_by(empty, "k", {"v": "median"}).collect()} == {None}


def test_median_shuffles_counters_only(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 20)
    plan = group_by(values_of(spark, {"a": range(900), "b": [1]}), "k", {"v": "median"})._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "RepartitionByExpression" not in plan


def test_median_of_long_integers(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 20)
    df = spark.range(1 << 60, (1 << 60) + 5000).select(F.lit(1).alias("k"), "id")
    assert group_by(df, "k", {"id": "median"}).first()["id"] == float((1 << 60) + 2500)


def test_sketches(spark, tmp_path):
    path = str(tmp_path / "sketches")
    df = spark.range(60_000).select((F.col("id") % 4).alias("k"), (F.col("id") * 7 % 9001).alias("v"), F.col("id").cast("string").alias("t"))
    df = df.withColumn("k", F.when(F.col("k") > 0, F.col("k"))).repartition(5)
    exact = {r["k"]: (r["v"], r["t"]) for r in df.groupBy("k").agg(F.countDistinct("v").alias("v"), F.countDistinct("t").alias("t")).collect()}
    near = lambda got, want: abs(got - want) <= distinct_bound() * want
    for r in group_by(df, "k", {"v": "nunique", "t": "nunique"}, keep_null_keys=True, approx=True).collect():
        assert near(r["v"], exact[r["k"]][0]) and near(r["t"], exact[r["k"]][1])
    for batch in ("a", "b", "b"):
        append_sketches(df.where("v < 5000" if batch == "a" else "v > 4000"), path, batch, "k", ["v", "t"])
    stored = read_sketches(spark, path, "k", ["v", "t"])
    assert stored.dtypes == [("k", "bigint"), ("v", "binary"), ("t", "binary")]
    for r in estimate_distinct(stored, ["v", "t"]).collect():
        assert near(r["v"], exact[r["k"]][0]) and near(r["t"], exact[r["k"]][1])
    whole = estimate_distinct(merge_sketches(stored, [], ["v", "t"]), ["v", "t"]).first()
    assert near(whole["v"], 9001) and near(whole["t"], 60_000)


def test_sketches_of_missing_values(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (1, None, 2.0), (2, "a", 2.0), (2, "a", float("nan"))], "k int, t string, x double")
    assert rows(group_by(df, "k", {"t": "nunique", "x": "nunique"}, approx=True)) == [(1, 0, 1), (2, 1, 1)]
    assert group_by(df.where("false"), [], {"t": "nunique"}, approx=True).first()["t"] == 0
    made = distinct_sketches(df, "k", ["t", "x"])
    assert rows(estimate_distinct(made, ["t", "x"])) == [(1, 0, 1), (2, 1, 1)]
    assert merge_sketches(made.where("false"), "k", "t").count() == 0
