"""Columns with awkward names, and row-wise operators over a stream."""

import pytest

from tablewright import (
    counter,
    date_diff,
    drop_duplicate_rows,
    fill_missing,
    filter_equals,
    filter_range,
    group_by,
    join_tables,
    keep_columns,
    list_pieces,
    number_to_string,
    query_by_keys,
    round_columns,
    rule_column,
    runs as R,
    sort_rows,
    split_cell,
    split_rows,
)

from .fixtures import edge, edge_empty

NAMES = ["key one", "g.x", "n`n", "x y.z", "t-t", "d d"]


@pytest.fixture
def odd(spark):
    return edge(spark).toDF(*NAMES)


def test_names_in_filters_and_columns(odd):
    assert filter_equals(odd, "g.x", "g1").count() == 3
    assert filter_range(odd, "x y.z", 0).count() == 3
    assert split_rows(odd, "n`n", "GT", "1")[0].count() == 4
    assert keep_columns(odd, ["x y.z", "n`n"]).columns == ["x y.z", "n`n"]
    assert round_columns(odd).columns == NAMES
    assert number_to_string(odd, "n`n").dtypes[2] == ("n`n", "string")
    assert split_cell(odd, "t-t", "e", 2).columns[-2:] == ["t-t_0", "t-t_1"]
    assert fill_missing(odd.drop("n`n", "g.x", "x y.z"), {"key one": "?"}).where("`key one` = '?'").count() == 1
    assert "date_diff" in date_diff(odd, "d d", "d d").columns


def test_names_in_joins_and_groups(odd):
    out = join_tables(odd, odd.drop("n`n"), "key one", how="outer")
    assert out.columns[:3] == ["key one", "g.x_x", "n`n"]
    assert query_by_keys(odd, odd, "key one").count() == 5
    got = group_by(odd, "g.x", {"x y.z": "median", "n`n": "mode", "t-t": "first"}, order_by="d d")
    assert got.columns == ["g.x", "x y.z", "n`n", "t-t"] and got.count() == 2
    assert drop_duplicate_rows(odd, ["g.x"], order_by="n`n").columns == NAMES
    assert counter(odd, "n`n").count() == 6 and counter(odd, "n`n", unique=True).count() == 6
    assert sort_rows(odd, "x y.z").columns == NAMES
    assert list_pieces(odd.distinct(), "g.x", "x y.z", ["key one"]).count() == 2
    assert R.stop_at_first_failure(odd, "g.x", "d d", status="t-t").columns == NAMES
    assert R.resolve_attempts(odd, "g.x", "n`n", "t-t").columns == NAMES


def test_row_operators_on_a_stream(spark, tmp_path):
    edge(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edge_empty(spark).schema).parquet(str(tmp_path / "in"))
    out = rule_column(filter_range(stream, "x", 0), "band", [("x > 3", "high")], "low").select("k", "band")
    run = out.writeStream.format("memory").queryName("bands").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("bands").collect()) == [("a", "low"), ("b", "high"), ("b", "high")]
