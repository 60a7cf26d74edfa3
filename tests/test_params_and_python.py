import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright import (
    for_each_group,
    named_queries,
    param_sweep,
    params_to_table,
    python_table,
    python_two_tables,
    read_sql,
    row_function,
    row_to_params,
    table_or_else,
    threshold_sweep,
    with_params,
)

from .fixtures import edge, edge_empty, hot, hot_rows, right_side


def test_params(spark):
    params = row_to_params(edge(spark).select("k", "n"), "n")
    assert params == {"k": "a", "n": 1}
    assert row_to_params(edge_empty(spark)) == {}
    assert params_to_table(spark, params).first().asDict() == params
    assert params_to_table(spark, params, "k string, n bigint").dtypes == [("k", "string"), ("n", "bigint")]
    assert params_to_table(spark, {}, "k string").count() == 0
    sql = "SELECT n FROM edge WHERE k = $${k}$$ AND n >= :n"
    assert read_sql(spark, sql, params, {"edge": edge(spark)}).count() == 1
    harmful = {"k": "a' OR '1' = '1", "n": 0}
    assert read_sql(spark, sql, harmful, {"edge": edge(spark)}).count() == 0


def test_named_queries(spark):
    edge(spark).createOrReplaceTempView("edge")
    queries = named_queries(spark, {"all_rows": "SELECT * FROM edge", "big": "SELECT k FROM edge WHERE n > :low"})
    assert queries.names() == ["all_rows", "big"]
    assert queries.function("big")(low=2).count() == 2
    queries.register_views()
    assert spark.table("all_rows").count() == 6
    with pytest.raises(KeyError):
        queries.run("none")


def test_params_stay_lazy(spark):
    top = edge(spark).agg(F.max("n").alias("top"), F.min("k").alias("low"))
    out = with_params(edge(spark), top)
    assert {(r["top"], r["low"]) for r in out.collect()} == {(3, "a")}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="(?i)more than one row"):
        with_params(edge(spark), right_side(spark)).collect()


def test_sweep(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    metric = lambda p: F.sum(F.pow(F.col("v") - p["c"], 2)) + p["z"]
    out = param_sweep(df, {"c": [1.0, 5.5, 9.0], "z": [0, 1]}, metric, width=4)
    assert out.count() == 6 and out.columns == ["c", "z", "metric"]
    assert param_sweep(df, {"c": [1.0, 5.5, 9.0], "z": [0, 1]}, metric, "min", 4).first().asDict() == {
        "c": 5.5, "z": 0, "metric": 82.5,
    }
    assert param_sweep(df, {"c": [1.0, 5.5], "z": [0]}, metric, "max").first()["c"] == 1.0


def test_switch(spark):
    df, fallback = edge(spark), right_side(spark)
    assert table_or_else(df.select("k", "x"), fallback).count() == 6
    assert table_or_else(df.select("k", "x").where("n > 99"), fallback).count() == 5
    assert table_or_else(edge_empty(spark).select("k", "x"), fallback).count() == 5


def test_python_table(spark):
    out = python_table(edge(spark), lambda rows: rows.assign(n=rows["n"] * 2), "n double, k string", ["k", "n"])
    assert sorted(r["n"] for r in out.collect() if r["k"] in ("a", "b")) == [2.0, 4.0, 4.0]
    out = python_two_tables(
        edge(spark), right_side(spark), "k",
        lambda rows: pd.DataFrame({"k": rows["k"], "s": rows["x_x"] + rows["x_y"]}), "k string, s double",
    )
    assert sorted(r["s"] for r in out.collect() if r["k"] == "b") == [23.5, 23.5, 24.5, 24.5]
    out = row_function(edge(spark), "up", lambda t: t.str.upper(), "string", "t")
    assert {r["up"] for r in out.collect()} == {"12", " 1E3 ", "X", "", None}


@pytest.mark.parametrize("batch, slice_rows", [(10_000, 100_000), (7, 3), (2, 20), (1, 5)])
def test_groups_of_any_size(spark, batch, slice_rows):
    """The result does not depend on how the rows are sliced."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        out = for_each_group(
            hot(spark),
            "key",
            lambda rows: {"n": len(rows), "top": rows["value"].max(), "last": rows["id"].max()},
            lambda states: {"n": states["n"].sum(), "top": states["top"].max(), "last": states["last"].max()},
            "n bigint, top double, last bigint",
            slice_rows=slice_rows,
        )
        got = {r["key"]: (r["n"], r["top"], r["last"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    frame = pd.DataFrame(hot_rows(3000), columns=["key", "value", "id"])
    want = frame.groupby("key").agg(n=("id", "size"), top=("value", "max"), last=("id", "max"))
    assert got == {int(k): (r["n"], r["top"], r["last"]) for k, r in want.iterrows()}


def test_calls_follow_groups(spark):
    """Groups whose rows are mixed over all tasks are not folded once per task, and a large one is still shared."""
    rows = spark.range(4000).select((F.col("id") % 100).alias("key"), "id").repartition(8, "id")
    out = for_each_group(
        rows,
        "key",
        lambda r: {"n": len(r), "calls": 1},
        lambda states: {"n": states["n"].sum(), "calls": states["calls"].sum()},
        "n bigint, calls bigint",
    ).collect()
    assert [r["n"] for r in out] == [40] * 100
    assert sum(r["calls"] for r in out) < 150  # once per group, and once more where a range ends inside one
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = for_each_group(
            rows.select(F.lit(1).alias("key"), F.lit("copy").alias("id")),
            "key",
            lambda r: {"n": len(r), "calls": 1},
            lambda states: {"n": states["n"].sum(), "calls": states["calls"].sum()},
            "n bigint, calls bigint",
        ).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out["n"] == 4000 and out["calls"] > 4


@pytest.mark.parametrize("batch, slice_rows", [(10_000, 100_000), (7, 3), (1, 5)])
def test_groups_in_frames(spark, batch, slice_rows):
    def step(names):
        return lambda f: f.groupby("key", as_index=False).agg(**names)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        out = for_each_group(
            hot(spark),
            "key",
            step({"n": ("id", "size"), "top": ("value", "max"), "last": ("id", "max")}),
            step({"n": ("n", "sum"), "top": ("top", "max"), "last": ("last", "max")}),
            "n bigint, top double, last bigint",
            slice_rows=slice_rows,
            frames=True,
        )
        got = {r["key"]: (r["n"], r["top"], r["last"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    frame = pd.DataFrame(hot_rows(3000), columns=["key", "value", "id"])
    want = frame.groupby("key").agg(n=("id", "size"), top=("value", "max"), last=("id", "max"))
    assert got == {int(k): (r["n"], r["top"], r["last"]) for k, r in want.iterrows()}


def test_group_output_expressions(spark):
    out = for_each_group(
        edge(spark), ["g"], lambda r: {"n": len(r)}, lambda s: {"n": s["n"].sum()}, "n bigint", {"twice": "n * 2"}
    )
    assert {r["g"]: r["twice"] for r in out.collect()} == {"g1": 6, "g2": 4}


METRICS = {"n": ("count", "w"), "total": ("sum", "w"), "low": ("min", "w"), "high": ("max", "w"), "mean": ("mean", "w")}
TESTS = {"<=": lambda v, t: v <= t, "<": lambda v, t: v < t, ">=": lambda v, t: v >= t, ">": lambda v, t: v > t}


@pytest.mark.parametrize("keep", TESTS)
@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("kind", [int, float])
def test_threshold_sweep(spark, keep, limit, kind):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.1 else kind(rng.randint(0, 60)), rng.choice([None, *range(9)])) for _ in range(800)]
    if kind is float:
        rows.append((float("nan"), 5))
    points = [None, *[kind(x) for x in (-5, 0, 1, 7, 7, 7, 59, 60, 61, *range(20, 40))]]
    name = "bigint" if kind is int else "double"
    df = spark.createDataFrame(rows, f"v {name}, w bigint").repartition(3)
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(points)], f"id int, t {name}")
    got = {r["id"]: r for r in threshold_sweep(df, "v", grid, "t", METRICS, keep, limit).collect()}
    assert set(got) == set(range(len(points)))
    for i, t in enumerate(points):
        kept = [w for v, w in rows if None not in (v, t, w) and v == v and TESTS[keep](v, t)]
        want = (len(kept), sum(kept), min(kept, default=None), max(kept, default=None), sum(kept) / len(kept) if kept else None)
        assert tuple(got[i][m] for m in METRICS) == want
    assert threshold_sweep(df, "v", grid.where("false"), "t", METRICS, keep, limit).count() == 0
    none = threshold_sweep(df.where("false"), "v", grid, "t", METRICS, keep, limit).collect()
    assert {tuple(r)[2:] for r in none} == {(0, 0, None, None, None)}


def test_threshold_sweep_refuses(spark):
    df = spark.range(3).withColumn("t", F.col("id"))
    for bad in (dict(keep="=="), dict(metrics={"n": ("median", "id")}), dict(metrics={"id": ("sum", "id")})):
        with pytest.raises(ValueError):
            threshold_sweep(**{"df": df, "col": "id", "grid": df, "threshold": "t", "metrics": {"n": ("sum", "id")}} | bad)


def test_sweep_over_a_table(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    grid = spark.createDataFrame([(1.0, "a"), (5.5, "b"), (5.5, "b"), (9.0, "c")], "c double, name string")
    metric = lambda p: F.sum(F.abs(F.col("v") - p["c"]))
    out = param_sweep(df, grid, metric)
    assert out.columns == ["c", "name", "metric"] and out.count() == 3
    assert param_sweep(df, grid, metric, "min").first()["name"] == "b"
    assert param_sweep(df, grid.where("false"), metric).count() == 0
