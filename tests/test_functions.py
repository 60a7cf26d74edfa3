import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright import (
    concat_text,
    current_timestamp_column,
    date_diff,
    double_to_int,
    extract_date_fields,
    format_datetime,
    if_else_columns,
    math_column,
    math_if,
    number_to_string,
    power,
    read_rules,
    replace_text,
    round_columns,
    rule_column,
    rule_text_column,
    set_time_of_day,
    shift_date,
    split_cell,
    string_to_number,
    system_columns,
    text,
    to_date_text,
    to_timestamp,
)

from .fixtures import edge


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def texts(spark, *items):
    return spark.createDataFrame([(t,) for t in items], "t string")


def test_rules(spark):
    df = edge(spark)
    rules = [("x > 3", "high"), ("x > 2", "middle"), ("n IN (3) AND x IS NULL", "gap")]
    out = {r["k"]: r["r"] for r in rule_column(df, "r", rules).collect()}
    assert out == {"a": "middle", "b": "high", "c": "Unknown", "d": "gap", None: "Unknown"}
    out = rule_column(df, "r", [("n = 1", 10), ("n = 2", 20)])
    assert {r["r"] for r in out.collect()} == {10, 20, None}
    out = rule_column(df, "r", [("n = 1", F.col("g")), ("TRUE", F.col("t"))])
    assert {r["k"]: r["r"] for r in out.collect()}["a"] == "g1"
    assert {r["r"] for r in rule_column(df, "r", []).collect()} == {"Unknown"}


def test_if_else_and_math(spark):
    df = edge(spark).where("k IN ('a', 'c')").orderBy("k")
    out = if_else_columns(df, "x > 0", {"p": (1, None), "q": (concat_text("<", F.col("k"), ">"), "no")}).collect()
    assert [(r["p"], r["q"]) for r in out] == [(1, "<a>"), (0, "no")]
    assert values(math_column(df, "y", "x * 2 + n"), "y") == [6.0, pytest.approx(-2.4)]
    assert values(df, power("n", 2)) == [1.0, 9.0]
    assert values(df, math_if(F.col("n") > 1, F.col("n"), 0)) == [0, 3]
    with pytest.raises(ValueError):
        math_column(df, "y", "x ^ 2")


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.125, 2.5, 3)], "a double, b double, c int")
    assert tuple(round_columns(df, "a", 2).first()) == (0.12, 2.5, 3)
    assert tuple(round_columns(df, precision=0).first()) == (0.0, 2.0, 3)
    assert round_columns(df).dtypes == df.dtypes


def test_conversions(spark):
    df = edge(spark)
    numbers = string_to_number(df, "t").orderBy("k", "n")
    assert {r["k"]: r["t"] for r in numbers.collect()} == {None: None, "a": 12.0, "b": 1000.0, "c": None, "d": None}
    odd = texts(spark, "1d", "2f", "0x1p3", "NaN", "-5", "1e400", ".5")
    assert values(string_to_number(odd, "t"), "t") == [None, None, None, None, -5.0, float("inf"), 0.5]
    whole = {r["k"]: r["x"] for r in double_to_int(df, "x").collect()}
    assert whole == {"a": 2, "b": 3, "c": -2, "d": None, None: None}
    assert double_to_int(df.where("n < 0"), "x", strict=True).count() == 0
    with pytest.raises(Exception, match="fraction"):
        double_to_int(df, "x", strict=True).collect()
    assert values(number_to_string(df, "n").where("k = 'a'"), "n") == ["1"]


def test_system_columns(spark):
    out = system_columns(edge(spark), "user", "rows", "i", order_by=["k", "n"]).collect()
    assert sorted(r["i"] for r in out) == list(range(6)) and {r["rows"] for r in out} == {6}
    assert all(r["user"] for r in out)
    with pytest.raises(ValueError):
        system_columns(edge(spark), row_index="i")


def test_text_positions(spark):
    df = texts(spark, "ab#12-7", "none", "", None)
    assert values(df, text.substr("t", 1, 2)) == ["b#", "on", "", None]
    assert values(df, text.index_of("t", "#")) == [2, -1, -1, None]
    assert values(df, text.int_after("t", "#", 1, 2)) == [12, None, None, None]
    assert values(texts(spark, "3.5kg", "kg"), text.double_before("t", "kg")) == [3.5, None]
    assert values(df, text.substr_int("t", 3, 2)) == [12, None, None, None]
    assert values(df, text.substr_double("t", 3, 2)) == [12.0, None, None, None]
    assert values(df, text.length("t")) == [7, 4, 0, None]
    assert values(df, text.missing("t")) == [False, False, False, True]
    assert values(df, text.truncate_text("t", 3)) == ["ab#", "non", "", ""]


def test_text_changes(spark):
    df = texts(spark, " \tA.b\n")
    assert values(df, text.strip("t")) == ["A.b"]
    assert values(df, text.upper_case(text.strip("t"))) == ["A.B"]
    assert values(df, text.lower_case("t")) == [" \ta.b\n"]
    assert values(replace_text(df, "t", ".", "$"), "t") == [" \tA$b\n"]
    assert values(replace_text(df, "t", "[Ab]", "x", regex=True), "t") == [" \tx.x\n"]
    assert values(texts(spark, "1\r\n2\n 3 \n\n", "", "one"), text.last_line("t")) == ["3", "", "one"]
    pair = spark.createDataFrame([("a", None, 1)], "a string, b string, c int")
    assert values(pair, text.join_text("-", "a", "b", "c")) == ["a-1"]
    assert values(pair, text.join_text("-", "a", "b", skip_missing=False)) == [None]
    assert values(pair, text.to_string("c")) == ["1"]
    assert values(texts(spark, "7", "x"), text.to_int("t")) == [7, None]
    assert values(texts(spark, "7", "x"), text.to_double("t")) == [7.0, None]


@pytest.mark.parametrize("sep", [",", ".", "|", "\\", "^-", "ab"])
def test_split_cell(spark, sep):
    df = texts(spark, sep.join("xyz"), "x", None)
    out = split_cell(df, "t", sep, 3)
    assert out.columns == ["t", "t_0", "t_1", "t_2"]
    assert [tuple(r)[1:] for r in out.collect()] == [("x", "y", "z"), ("x", None, None), (None, None, None)]
    assert split_cell(df, "t", sep, 2).columns == ["t", "t_0", "t_1"]
    assert [r["t_parts"] for r in split_cell(df, "t", sep).collect()] == [["x", "y", "z"], ["x"], None]


def test_dates(spark):
    df = edge(spark)
    parsed = to_timestamp(texts(spark, "2024-02-29 10:00:00", "2024-02-30", "x"), "t")
    assert parsed.dtypes == [("t", "timestamp_ntz")]
    assert values(parsed, "t") == [dt.datetime(2024, 2, 29, 10), None, None]
    assert values(to_timestamp(texts(spark, "29/02/2024", "2024"), "t", "dd/MM/yyyy"), "t") == [dt.datetime(2024, 2, 29), None]
    assert values(to_date_text(df.where("k = 'c'"), "d"), "d") == ["2024-02-29"]
    both = spark.createDataFrame(
        [(dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3, 23)), (dt.datetime(2024, 1, 5), None)],
        "a timestamp_ntz, b timestamp_ntz",
    )
    assert values(date_diff(both, "a", "b"), "date_diff") == [-2, None]
    assert values(date_diff(both, "a", "b", "Hours"), "date_diff") == [-47.0, None]
    assert values(date_diff(both, "a", "b", "SECONDS"), "date_diff") == [-dt.timedelta(hours=47), None]
    fields = extract_date_fields(df.where("k = 'd'"), "d", ["year", "month", "day", "hour"]).first()
    assert (fields["year"], fields["month"], fields["day"], fields["hour"]) == (2024, 12, 31, 23)
    with pytest.raises(ValueError):
        extract_date_fields(df, "d", ["week"])
    assert values(shift_date(df.where("k = 'd'"), "d"), "d") == [dt.datetime(2025, 1, 1, 23, 59, 59)]
    assert values(shift_date(both, "a", -3, "hour"), "a")[0] == dt.datetime(2024, 1, 1, 21)
    assert values(set_time_of_day(both, "b", 8, 5), "b") == [dt.datetime(2024, 1, 3, 8, 5), None]
    fixed = current_timestamp_column(both, "now", at=dt.datetime(2024, 1, 1))
    assert values(fixed, "now") == [dt.datetime(2024, 1, 1)] * 2
    assert current_timestamp_column(both, "now").where("now IS NULL").count() == 0


def test_readable_dates(spark):
    df = texts(spark, "2026-02-09T06:00:01.123456", "2026-02-09", "2026", "soon", None)
    want = ["09/02/2026 06:00:01", "09/02/2026 00:00:00", "2026", "soon", None]
    assert values(format_datetime(df, "t"), "t") == want


def test_rule_text(spark):
    rows = [(1, "it's", 2.0), (2, "a => b", float("nan")), (3, None, 5.0), (4, "\\", None)]
    df = spark.createDataFrame(rows, "`my id` int, t string, x double")
    text = """
        // $t$ = "x" => "comment"
        $t$ = "it's" => "quote"
        no rule here
        $t$ = "\\" => "back\\slash"
        NOT MISSING $x$ AND $my id$ > 2 => $my id$
        MISSING $x$ => "gone"
    """
    got = rule_text_column(df, "r", text)
    assert got.columns == ["my id", "t", "x", "r"]
    assert [r["r"] for r in got.orderBy("my id").collect()] == ["quote", "gone", "3", "back\\slash"]
    assert [r["r"] for r in rule_text_column(df, "r", "$x$ >= 5 => 1\nFALSE => 0").orderBy("my id").collect()] == [0, 0, 1, 0]
    assert {r["r"] for r in rule_text_column(df, "r", "// nothing").collect()} == {"Unknown"}
    assert [c for c, _ in read_rules('$a$ IN ("$b$", "MISSING $c$") => 1')] == ["`a` IN ('$b$', 'MISSING $c$')"]
