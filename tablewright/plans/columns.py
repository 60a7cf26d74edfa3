"""Queries for conditional, numeric, text and date columns."""

from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.conditions import (
    concat_text,
    double_to_int,
    if_else_columns,
    math_column,
    math_if,
    number_to_string,
    power,
    round_columns,
    rule_column,
    string_to_number,
    system_columns,
)
from ..operators.joins import join_tables
from ..functions.rules import rule_text_column
from .registry import query


# -- conditions and numbers

@query(
    "rule_engine",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 AND o_orderstatus = 'F' THEN 'top'"
    " WHEN o_totalprice > 200000 THEN 'high' WHEN NOT o_orderstatus = 'O' THEN 'low' ELSE 'Unknown' END AS band FROM orders",
)
def _(t):
    rules = [
        ("o_totalprice > 400000 AND o_orderstatus = 'F'", "top"),
        ("o_totalprice > 200000", "high"),
        ("NOT o_orderstatus = 'O'", "low"),
    ]
    return rule_column(t.orders, "band", rules).select("o_orderkey", "band")


RULE_TEXT = """
// the first rule that holds decides
$o_totalprice$ > 400000 AND $o_orderstatus$ = "F" => "top"
$o_orderpriority$ IN ("1-URGENT", "2-HIGH") OR NOT $o_totalprice$ > 1500 => $o_orderpriority$

MISSING $o_orderstatus$ => "no state"
TRUE => "rest => other"
"""


@query(
    "rule_text",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 AND s = 'F' THEN 'top' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')"
    " OR NOT o_totalprice > 1500 THEN o_orderpriority WHEN s IS NULL THEN 'no state' ELSE 'rest => other' END AS band"
    " FROM (SELECT *, nullif(o_orderstatus, 'P') AS s FROM orders)",
)
def _(t):
    df = t.orders.withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    return rule_text_column(df, "band", RULE_TEXT).select("o_orderkey", "band")


@query(
    "rule_in_missing",
    "SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 0"
    " WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 2 END AS code FROM orders",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderpriority", F.expr("nullif(o_orderstatus, 'P')").alias("s"))
    rules = [("s IS NULL", 0), ("o_orderpriority IN ('1-URGENT', '2-HIGH')", 1), ("TRUE", 2)]
    return rule_column(df, "code", rules).select("o_orderkey", "code")


@query(
    "rule_column_value",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_name END AS shown FROM customer",
)
def _(t):
    rules = [(F.col("c_acctbal") < 0, F.col("c_mktsegment"))]
    return rule_column(t.customer, "shown", rules, F.col("c_name")).select("c_custkey", "shown")


@query(
    "math_formula",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem",
)
def _(t):
    df = math_column(t.lineitem, "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "charge")


@query("math_power", "SELECT p_partkey, pow(p_size, 2) AS squared FROM part")
def _(t):
    return math_column(t.part, "squared", power("p_size", 2)).select("p_partkey", "squared")


@query("math_if", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice END AS p FROM part")
def _(t):
    price = math_if("p_size > 25", F.col("p_retailprice") * 2, F.col("p_retailprice"))
    return math_column(t.part, "p", price).select("p_partkey", "p")


@query("round_half_even", "SELECT l_orderkey, l_partkey, round_even(l_quantity / 8, 2) AS eighth FROM lineitem")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", (F.col("l_quantity") / 8).alias("eighth"))
    return round_columns(df, "eighth", 2)


@query("num_to_str", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def _(t):
    return number_to_string(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"])


@query(
    "str_to_num",
    "SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS n,"
    " TRY_CAST(o_orderpriority AS DOUBLE) AS bad FROM orders",
)
def _(t):
    df = t.orders.select("o_orderkey", F.substring_index("o_orderpriority", "-", 1).alias("n"), F.col("o_orderpriority").alias("bad"))
    return string_to_number(df, ["n", "bad"])


@query("dbl_to_int", "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS c_acctbal FROM customer")
def _(t):
    return double_to_int(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal")


@query(
    "if_else_multi",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS flag,"
    " CASE WHEN c_acctbal > 0 THEN concat('ok ', c_name) ELSE 'in debt' END AS note FROM customer",
)
def _(t):
    outputs = {"flag": (1, None), "note": (concat_text("ok ", F.col("c_name")), "in debt")}
    return if_else_columns(t.customer, "c_acctbal > 0", outputs).select("c_custkey", "flag", "note")


@query("concat_text", "SELECT concat('order ', o_orderkey, ' of ', o_custkey, '.') AS t FROM orders")
def _(t):
    return t.orders.select(concat_text("order ", F.col("o_orderkey"), " of ", F.col("o_custkey"), ".").alias("t"))


@query(
    "system_values",
    "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, (SELECT count(*) FROM customer) AS n FROM customer",
)
def _(t):
    return system_columns(t.customer.select("c_custkey"), None, "n", "i", "c_custkey", unique=True)


# -- text

@query("str_substr", "SELECT c_custkey, substr(c_name, 1, 4) AS s FROM customer")
def _(t):
    return t.customer.select("c_custkey", text.substr("c_name", 0, 4).alias("s"))


@query("str_substr_int", "SELECT c_custkey, CAST(substr(c_name, 10, 9) AS BIGINT) AS n FROM customer")
def _(t):
    return t.customer.select("c_custkey", text.substr_int("c_name", 9, 9).alias("n"))


@query("str_substr_dbl", "SELECT c_custkey, TRY_CAST(substr(c_name, 9, 10) AS DOUBLE) AS bad, CAST(substr(c_name, 16, 3) AS DOUBLE) AS x FROM customer")
def _(t):
    return t.customer.select(
        "c_custkey", text.substr_double("c_name", 8, 10).alias("bad"), text.substr_double("c_name", 15, 3).alias("x")
    )


@query(
    "str_find_slice",
    "SELECT p_partkey, CASE WHEN instr(p_brand, '#') > 0 THEN TRY_CAST(substr(p_brand, instr(p_brand, '#') + 1, 2) AS BIGINT) END AS n FROM part",
)
def _(t):
    return t.part.select("p_partkey", text.int_after("p_brand", "#", 1, 2).alias("n"))


@query(
    "str_prefix",
    "SELECT o_orderkey, CASE WHEN instr(o_orderpriority, '-') > 0 THEN"
    " TRY_CAST(substr(o_orderpriority, 1, instr(o_orderpriority, '-') - 1) AS DOUBLE) END AS level FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", text.double_before("o_orderpriority", "-").alias("level"))


@query("str_index_of", "SELECT p_partkey, CAST(instr(p_name, 'r') - 1 AS INTEGER) AS at FROM part")
def _(t):
    return t.part.select("p_partkey", text.index_of("p_name", "r").alias("at"))


@query("str_case", "SELECT doc_id, upper(lang) AS up, lower(source) AS low FROM documents")
def _(t):
    return t.documents.select("doc_id", text.upper_case("lang").alias("up"), text.lower_case("source").alias("low"))


@query("str_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", text.length("text").alias("n"))


@query("str_trim", "SELECT p_partkey, p_name AS s FROM part")
def _(t):
    return t.part.select("p_partkey", text.strip(F.concat(F.lit(" \t"), "p_name", F.lit("\n "))).alias("s"))


@query("str_replace", "SELECT doc_id, replace(text, 'en', '_') AS text FROM documents")
def _(t):
    return text.replace_text(t.documents.select("doc_id", "text"), "text", "en", "_")


@query("str_replace_regex", "SELECT doc_id, regexp_replace(text, '[aeiou]{2}', '*', 'g') AS text FROM documents")
def _(t):
    return text.replace_text(t.documents.select("doc_id", "text"), "text", "[aeiou]{2}", "*", regex=True)


@query("str_join", "SELECT p_partkey, concat_ws(' / ', p_brand, nullif(p_type, 'PROMO'), p_size) AS s FROM part")
def _(t):
    return t.part.select("p_partkey", text.join_text(" / ", "p_brand", F.expr("nullif(p_type, 'PROMO')"), "p_size").alias("s"))


@query(
    "cell_split",
    "SELECT o_orderkey, o_orderpriority, split_part(o_orderpriority, '-', 1) AS o_orderpriority_0,"
    " split_part(o_orderpriority, '-', 2) AS o_orderpriority_1, string_split(o_orderpriority, '-')[-1] AS last FROM orders",
)
def _(t):
    df = text.split_cell(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", 2)
    parts = text.split_cell(df, "o_orderpriority", "-")
    return parts.withColumn("last", F.element_at("o_orderpriority_parts", -1)).drop("o_orderpriority_parts")


@query("str_last_line", "SELECT conv_id, turn, trim(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[-1]) AS s FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", text.last_line("text").alias("s"))


@query("str_truncate", "SELECT p_partkey, substr(coalesce(nullif(p_type, 'PROMO'), ''), 1, 4) AS s FROM part")
def _(t):
    return t.part.select("p_partkey", text.truncate_text(F.expr("nullif(p_type, 'PROMO')"), 4).alias("s"))


# -- dates

@query(
    "date_parse",
    "SELECT o_orderkey, o_orderdate AS a, o_orderdate AS b, CAST(NULL AS TIMESTAMP) AS bad FROM orders",
)
def _(t):
    df = t.orders.select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("a"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("b"),
        F.col("o_orderpriority").alias("bad"),
    )
    return dates.to_timestamp(dates.to_timestamp(df, ["a", "bad"]), "b", "dd/MM/yyyy")


@query("date_format", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts FROM events")
def _(t):
    return dates.to_date_text(t.events.select("event_id", "ts"), "ts")


def shipped(t):
    left = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), "l_partkey", "l_shipdate")
    return join_tables(left, t.orders.select(F.col("o_orderkey").alias("orderkey"), "o_orderdate"), "orderkey")


@query(
    "date_diff_days",
    "SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 86400000000.0) AS BIGINT) AS date_diff FROM events",
)
def _(t):
    df = t.events.select("event_id", "ts", F.expr("timestamp_ntz'2024-01-15 12:00:00'").alias("mid"))
    return dates.date_diff(df, "ts", "mid").select("event_id", "date_diff")


@query(
    "date_diff_hours",
    "SELECT l_orderkey AS orderkey, l_partkey, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0 AS hours"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(t):
    return dates.date_diff(shipped(t), "l_shipdate", "o_orderdate", "HOURS", "hours").select("orderkey", "l_partkey", "hours")


@query("date_diff_interval", "SELECT event_id, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS BIGINT) AS micros FROM events")
def _(t):
    df = t.events.select("event_id", "ts", F.expr("timestamp_ntz'2024-01-01'").alias("mid"))
    df = dates.date_diff(df, "ts", "mid", "RAW", "gap")
    exact = F.expr("timestampdiff(MICROSECOND, mid, mid + gap)")
    return df.select("event_id", exact.alias("micros"))


@query("date_current", "SELECT c_custkey, TIMESTAMP '2024-05-06 07:08:09' AS date FROM customer")
def _(t):
    return dates.current_timestamp_column(t.customer.select("c_custkey"), "date", at="2024-05-06 07:08:09")


@query(
    "date_fields",
    "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour FROM events",
)
def _(t):
    df = dates.extract_date_fields(t.events, "ts", ["year", "month", "day", "hour"])
    return df.select("event_id", "year", "month", "day", "hour")


@query("date_shift", "SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY AS o_orderdate, o_orderdate - INTERVAL 90 MINUTE AS earlier FROM orders")
def _(t):
    df = dates.shift_date(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", -90, "minute", out="earlier")
    return dates.shift_date(df, "o_orderdate")


@query("date_set_time", "SELECT event_id, date_trunc('day', ts) + INTERVAL '9 hours 30 minutes 15 seconds' AS ts FROM events")
def _(t):
    return dates.set_time_of_day(t.events.select("event_id", "ts"), "ts", 9, 30, 15)


@query("date_br_format", "SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS shown, event_type FROM events")
def _(t):
    df = t.events.select("event_id", F.col("ts").cast("string").alias("shown"), "event_type")
    return dates.format_datetime(dates.format_datetime(df, "shown"), "event_type")
