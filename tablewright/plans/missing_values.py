"""Queries on columns that hold NaN, and on outcomes of mixed types."""

from pyspark.sql import functions as F

from ..functions import text
from ..functions.conditions import assign_column, if_else_columns, rule_column
from ..operators.filters import rule_filter
from .registry import query

# Orders in part (status P) have NaN as their price.
PRICE = "CASE WHEN o_orderstatus = 'P' THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END"


def priced(t):
    return t.orders.select("o_orderkey", "o_orderstatus", F.expr(PRICE).alias("price"))


@query(
    "rule_filter_nan",
    f"SELECT o_orderkey, o_orderstatus, {PRICE} AS price FROM orders"
    " WHERE o_orderstatus <> 'P' AND o_totalprice > 200000 OR NOT (o_orderstatus <> 'P' AND o_totalprice > 1000)",
)
def _(t):
    return rule_filter(priced(t), [("price > 200000", True), ("price > 1000", False)])


@query(
    "rule_engine_nan",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'none' WHEN o_totalprice > 300000 THEN 'high'"
    " WHEN o_totalprice >= 0 THEN 'low' ELSE 'Unknown' END AS label FROM orders",
)
def _(t):
    rules = [("price > 300000", "high"), ("price IS NULL", "none"), (F.col("price") >= 0, "low")]
    return rule_column(priced(t), "label", rules).select("o_orderkey", "label")


@query(
    "if_else_nan",
    f"SELECT o_orderkey, {PRICE} AS price, CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 100000 THEN 1 ELSE 0 END AS large"
    " FROM orders",
)
def _(t):
    return if_else_columns(priced(t), "price > 100000", {"large": (1, None)}).select("o_orderkey", "price", "large")


@query("if_else_text", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE '0' END AS size FROM orders")
def _(t):
    return if_else_columns(t.orders, "o_totalprice > 100000", {"size": ("large", None)}).select("o_orderkey", "size")


@query(
    "rule_default_column",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN o_orderpriority ELSE 'Unknown' END AS label,"
    " CASE WHEN o_totalprice > 300000 THEN 'high' ELSE '7' END AS mixed FROM orders",
)
def _(t):
    df = rule_column(t.orders, "label", [("o_totalprice > 300000", F.col("o_orderpriority"))])
    df = rule_column(df, "mixed", [("o_totalprice > 300000", "high"), ("TRUE", 7)])
    return df.select("o_orderkey", "label", "mixed")


@query(
    "str_missing",
    "SELECT o_orderkey, o_orderstatus = 'P' AS no_price, false AS no_status,"
    " nullif(o_orderstatus, 'F') IS NULL AS no_part FROM orders",
)
def _(t):
    df = priced(t).withColumn("part", F.expr("nullif(o_orderstatus, 'F')"))
    return df.select(
        "o_orderkey",
        text.missing("price").alias("no_price"),
        text.missing("o_orderstatus").alias("no_status"),
        text.missing("part").alias("no_part"),
    )


@query("num_to_text", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS VARCHAR) || '.5' END AS shown FROM orders")
def _(t):
    half = F.expr("CASE WHEN o_orderstatus = 'P' THEN CAST('NaN' AS DOUBLE) ELSE o_orderkey + 0.5D END")
    return t.orders.select("o_orderkey", text.to_string(half).alias("shown"))


@query(
    "to_numbers",
    "SELECT o_orderkey, CAST(o_orderkey * 10 AS BIGINT) AS whole, o_orderkey + 0.25::DOUBLE AS part, NULL::BIGINT AS none FROM orders",
)
def _(t):
    key = F.col("o_orderkey").cast("string")
    return t.orders.select(
        "o_orderkey",
        text.to_int(F.concat(key, F.lit("0"))).alias("whole"),
        text.to_double(F.concat(key, F.lit(".25"))).alias("part"),
        text.to_int(F.col("o_orderpriority")).alias("none"),
    )


@query("assign_column", "SELECT c_custkey, 'new' AS state, c_acctbal AS balance FROM customer")
def _(t):
    df = assign_column(assign_column(t.customer, "state", "new"), "balance", F.col("c_acctbal"))
    return df.select("c_custkey", "state", "balance")
