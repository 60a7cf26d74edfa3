import pytest
from pyspark.sql import functions as F

from tablewright import (
    constant_column,
    filter_ci,
    filter_equals,
    filter_has_value,
    filter_missing,
    filter_range,
    keep_columns,
    rename_columns,
    reorder_columns,
    rule_filter,
    split_rows,
)

from .fixtures import edge, edge_empty, rows


def keys(df):
    return sorted(str(r["k"]) for r in df.collect())


def test_columns(spark):
    df = edge(spark)
    assert keep_columns(df, ["x", "k"]).columns == ["x", "k"]
    assert rename_columns(df, {"k": "key", "none": "y"}).columns == ["key", "g", "n", "x", "t", "d"]
    assert reorder_columns(df, ["d", "k"]).columns == ["d", "k"]
    assert reorder_columns(df, ["d", "k"], keep_rest=True).columns == ["d", "k", "g", "n", "x", "t"]
    out = constant_column(constant_column(df, "n", "5", "int"))
    assert dict(out.dtypes)["n"] == "bigint" and out.first()["new_column"] == ""
    with pytest.raises(ValueError):
        keep_columns(df, ["nope"])
    with pytest.raises(ValueError):
        rename_columns(df, {"k": "g"})


def test_equality_keeps_missing_on_not_equal(spark):
    df = edge(spark)
    assert keys(filter_equals(df, "g", "g1")) == ["a", "b", "b"]
    assert keys(filter_equals(df, "g", "g1", include=False)) == ["None", "c", "d"]
    assert keys(filter_equals(df, "n", "3")) == ["c", "d"]
    assert keys(filter_equals(df, "x", 3.5, include=False)) == ["None", "a", "c", "d"]


def test_range_treats_nan_as_missing(spark):
    df = edge(spark)
    assert keys(filter_range(df, "x", lower=0)) == ["a", "b", "b"]
    assert keys(filter_range(df, "x", upper=2.5)) == ["a", "c"]
    assert keys(filter_range(df, "x", 0, 3, include=False)) == ["None", "b", "b", "c", "d"]
    assert keys(filter_range(df, "d", "2024-01-03", "2024-03-01")) == ["b", "b", "c"]
    assert keys(filter_range(df, "n", 1.5, 2.5)) == ["b", "b"]
    with pytest.raises(ValueError):
        filter_range(df, "x")


def test_missing(spark):
    df = edge(spark)
    assert keys(filter_missing(df, "x")) == ["None", "d"]
    assert keys(filter_missing(df, "x", include=False)) == ["a", "b", "b", "c"]
    assert keys(filter_has_value(df, "t")) == ["None", "a", "b", "b", "c"]


@pytest.mark.parametrize(
    "op, value, expected",
    [
        ("EQ", "2", ["b", "b"]),
        ("NEQ", "2", ["None", "a", "c", "d"]),
        ("LT", "2", ["a"]),
        ("LTE", "2", ["a", "b", "b"]),
        ("GT", "1.5", ["b", "b", "c", "d"]),
        ("GTE", "3", ["c", "d"]),
        ("ANY", "3", ["c", "d"]),
        (None, None, ["a", "b", "b", "c", "d"]),
    ],
)
def test_split(spark, op, value, expected):
    df = edge(spark)
    match, rest = split_rows(df, "n", op, value)
    assert keys(match) == expected
    assert sorted(keys(match) + keys(rest)) == keys(df)


def test_split_text(spark):
    df = edge(spark)
    assert keys(split_rows(df, "t", "LIKE", r"\d")[0]) == ["a", "b", "b"]
    assert keys(split_rows(df, "t", "LIKE", "1.", literal=True)[0]) == []
    assert keys(split_rows(df, "x", "GT", "0")[0]) == ["a", "b", "b"]


def test_rule_filter(spark):
    df = edge(spark)
    assert keys(rule_filter(df, [("n > 2", True), (F.col("g") == "g1", True)])) == ["a", "b", "b", "c", "d"]
    assert keys(rule_filter(df, [("n >= 2", False)])) == ["None", "a"]
    assert keys(rule_filter(df, [])) == keys(df)
    assert keys(filter_ci(df, "g", "G2")) == ["None", "d"]


def test_filters_reach_the_scan(spark, tmp_path):
    edge(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for out in (filter_range(df, "x", 1, 3), filter_equals(df, "n", "2"), filter_range(df, "d", "2024-01-03")):
        plan = out.select("k")._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert "GreaterThanOrEqual" in pushed or "EqualTo" in pushed


def test_empty(spark):
    df = edge_empty(spark)
    assert rows(filter_range(df, "x", 0)) == [] and rows(split_rows(df, "n", "EQ", "1")[1]) == []
