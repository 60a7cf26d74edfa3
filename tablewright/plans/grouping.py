"""Queries for aggregation and user code over tables and groups."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators.aggregates import aggregate_columns, group_by, list_pieces
from ..operators.joins import join_tables
from ..operators.python_code import for_each_group, python_table, python_two_tables, row_function
from ..operators.sketches import append_sketches, distinct_bound, estimate_distinct, merge_sketches, read_sketches
from ..session import new_path
from .registry import query


def rounded(df, digits=2):
    """Sums of doubles depend on the order of addition in the last digits."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


@query(
    "group_sum",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity,"
    " round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY ALL",
)
def _(t):
    return rounded(
        group_by(t.lineitem, ["l_returnflag", "l_linestatus"], {"l_quantity": "Sum_V2.5.2", "l_extendedprice": "sum"})
    )


@query(
    "group_null_keys",
    "SELECT s, round(coalesce(sum(p), 0), 2) AS p FROM (SELECT nullif(o_orderstatus, 'P') AS s,"
    " CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS p FROM orders) WHERE s IS NOT NULL GROUP BY s",
)
def _(t):
    df = t.orders.selectExpr("nullif(o_orderstatus, 'P') AS s", "CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS p")
    return rounded(group_by(df, "s", {"p": "sum"}))


@query("group_mean", "SELECT p_brand, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY p_brand")
def _(t):
    return rounded(group_by(t.part, "p_brand", {"p_retailprice": "Mean"}), 4)


@query("group_count", "SELECT user_id, CAST(count(nullif(event_type, 'error')) AS BIGINT) AS event_type FROM events GROUP BY user_id")
def _(t):
    df = t.events.select("user_id", F.expr("nullif(event_type, 'error')").alias("event_type"))
    return group_by(df, "user_id", {"event_type": "Count"})


@query("group_min_max", "SELECT o_custkey, min(o_orderdate) AS o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey")
def _(t):
    return group_by(t.orders, "o_custkey", {"o_orderdate": "Min", "o_totalprice": "Max"})


@query(
    "group_median",
    "SELECT l_returnflag, round(median(l_extendedprice), 4) AS l_extendedprice,"
    " CAST(count(l_quantity) AS BIGINT) AS l_quantity FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    df = t.lineitem.select("l_returnflag", "l_extendedprice", "l_quantity")
    return rounded(group_by(df, "l_returnflag", {"l_extendedprice": "Median", "l_quantity": "count"}), 4)


@query(
    "group_std_var",
    "SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS l_quantity, round(var_samp(l_tax), 8) AS l_tax"
    " FROM lineitem GROUP BY l_linestatus",
)
def _(t):
    df = group_by(t.lineitem, "l_linestatus", {"l_quantity": "Standard deviation", "l_tax": "Variance"})
    return df.select("l_linestatus", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 8).alias("l_tax"))


@query(
    "group_first_last",
    "SELECT user_id, arg_min(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)
def _(t):
    return group_by(t.events, "user_id", {"value": "First", "event_type": "Last"}, order_by="event_id")


@query("group_nunique", "SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS l_partkey FROM lineitem GROUP BY l_returnflag")
def _(t):
    return group_by(t.lineitem, "l_returnflag", {"l_partkey": "Unique count"})


@query("group_nunique_approx", "SELECT DISTINCT l_returnflag, true AS within FROM lineitem")
def _(t):
    """Whether the estimate is within the stated error of the exact count."""
    exact = group_by(t.lineitem, "l_returnflag", {"l_partkey": "Unique count"}).withColumnRenamed("l_partkey", "exact")
    near = group_by(t.lineitem, "l_returnflag", {"l_partkey": "Unique count"}, approx=True)
    within = F.abs(F.col("l_partkey") - F.col("exact")) <= distinct_bound() * F.col("exact")
    return join_tables(near, exact, "l_returnflag").select("l_returnflag", within.alias("within"))


@query(
    "distinct_sketch_table",
    "SELECT DISTINCT o_orderstatus, true AS within FROM orders UNION ALL SELECT NULL, true",
)
def _(t):
    """Sketches of two batches of orders, the second of them added twice; the last row is the merge of all groups."""
    path = new_path(t.spark, "sketches")
    early = F.col("o_orderkey") % 3 == 0
    for batch, rows in (("1", t.orders.where(early)), ("2", t.orders.where(~early)), ("2", t.orders.where(~early))):
        append_sketches(rows, path, batch, "o_orderstatus", "o_custkey")
    stored = read_sketches(t.spark, path, "o_orderstatus", "o_custkey")
    whole = merge_sketches(stored, [], "o_custkey").withColumn("o_orderstatus", F.lit(None).cast("string"))
    near = estimate_distinct(stored.unionByName(whole), "o_custkey")
    exact = group_by(t.orders, "o_orderstatus", {"o_custkey": "Unique count"}).unionByName(
        group_by(t.orders, [], {"o_custkey": "Unique count"}).withColumn("o_orderstatus", F.lit(None).cast("string"))
    ).withColumnRenamed("o_custkey", "exact")
    within = F.abs(F.col("o_custkey") - F.col("exact")) <= distinct_bound() * F.col("exact")
    return join_tables(near, exact, "o_orderstatus").select("o_orderstatus", within.alias("within"))


@query(
    "group_list",
    "SELECT user_id, CAST(n // 20 AS BIGINT) AS piece, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) AS ids FROM"
    " (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) GROUP BY ALL",
)
def _(t):
    df = list_pieces(t.events.select("user_id", "event_id"), "user_id", "event_id", "event_id", piece_rows=20)
    return df.select("user_id", "piece", F.array_join(F.col("event_id").cast("array<string>"), ",").alias("ids"))


@query(
    "group_mode",
    "SELECT l_returnflag, l_quantity FROM (SELECT l_returnflag, l_quantity, row_number() OVER"
    " (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS rn FROM lineitem"
    " GROUP BY l_returnflag, l_quantity) WHERE rn = 1",
)
def _(t):
    return group_by(t.lineitem, "l_returnflag", {"l_quantity": "Mode"})


@query(
    "group_first_all",
    "SELECT event_type, arg_min(event_id, event_id) AS event_id, arg_min(user_id, event_id) AS user_id,"
    " arg_min(value, event_id) AS value FROM events GROUP BY event_type",
)
def _(t):
    df = t.events.select("event_type", "event_id", "user_id", "value")
    return group_by(df, "event_type", order_by="event_id")


@query(
    "agg_global",
    "SELECT round(sum(o_totalprice), 2) AS o_totalprice, CAST(count(DISTINCT o_custkey) AS BIGINT) AS o_custkey,"
    " max(o_orderdate) AS o_orderdate, (SELECT round(median(o_orderkey), 4) FROM orders) AS o_orderkey FROM orders",
)
def _(t):
    methods = {"o_totalprice": "sum", "o_custkey": "Unique count", "o_orderdate": "max", "o_orderkey": "median"}
    return rounded(group_by(t.orders, [], methods))


@query(
    "column_aggregate",
    "SELECT CAST(sum(p_partkey) AS BIGINT) AS p_partkey, CAST(sum(p_size) AS BIGINT) AS p_size,"
    " round(sum(p_retailprice), 2) AS p_retailprice FROM part",
)
def _(t):
    return rounded(aggregate_columns(t.part))


# -- user code

@query("python_table", "SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 25")
def _(t):
    def net(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["l_quantity"] > 25]
        return pd.DataFrame(
            {
                "l_orderkey": rows["l_orderkey"],
                "l_partkey": rows["l_partkey"],
                "net": rows["l_extendedprice"] * (1 - rows["l_discount"]),
            }
        )

    cols = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"]
    return python_table(t.lineitem, net, "l_orderkey bigint, l_partkey bigint, net double", cols)


@query(
    "python_cogroup",
    "SELECT o_orderkey AS orderkey, l_partkey, CAST(date_diff('day', o_orderdate, l_shipdate) AS BIGINT) AS days"
    " FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
)
def _(t):
    def waiting(rows: pd.DataFrame) -> pd.DataFrame:
        days = (rows["l_shipdate"] - rows["o_orderdate"]).dt.days
        return rows[["orderkey", "l_partkey"]].assign(days=days)

    a = t.orders.select(F.col("o_orderkey").alias("orderkey"), "o_orderdate")
    b = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), "l_partkey", "l_shipdate")
    return python_two_tables(a, b, "orderkey", waiting, "orderkey bigint, l_partkey bigint, days bigint")


@query("row_udf", "SELECT event_id, value, round(ln(1 + value), 6) AS log_value FROM events")
def _(t):
    df = row_function(t.events.select("event_id", "value"), "log_value", lambda v: np.log1p(v), "double", "value")
    return df.withColumn("log_value", F.round("log_value", 6))


@query(
    "group_loop",
    "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total, max(value) AS top,"
    " arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id",
)
def _(t):
    def fold(rows: pd.DataFrame) -> dict:
        first = rows.loc[rows["event_id"].idxmin()]
        return {
            "n": len(rows),
            "total": rows["value"].sum(),
            "top": rows["value"].max(),
            "first_id": first["event_id"],
            "first_type": first["event_type"],
        }

    def merge(states: pd.DataFrame) -> dict:
        first = states.loc[states["first_id"].idxmin()]
        return {
            "n": states["n"].sum(),
            "total": states["total"].sum(),
            "top": states["top"].max(),
            "first_id": first["first_id"],
            "first_type": first["first_type"],
        }

    return for_each_group(
        t.events.select("user_id", "event_id", "event_type", "value"),
        "user_id",
        fold,
        merge,
        "n bigint, total double, top double, first_id bigint, first_type string",
        {"n": "n", "total": "round(total, 2)", "top": "top", "first_type": "first_type"},
    )


@query(
    "user_aggregate",
    "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted"
    " FROM lineitem GROUP BY ALL",
)
def _(t):
    """Few large groups, so their rows stay where they are."""
    keys = ["l_returnflag", "l_linestatus"]

    def sums(states: pd.DataFrame) -> pd.DataFrame:
        return states.groupby(keys, sort=False, as_index=False)[["top", "weight"]].sum()

    return for_each_group(
        t.lineitem.select(*keys, "l_extendedprice", "l_quantity"),
        keys,
        lambda rows: sums(rows.assign(top=rows["l_extendedprice"] * rows["l_quantity"], weight=rows["l_quantity"])),
        sums,
        "top double, weight double",
        {"weighted": "round(top / weight, 4)"},
        frames=True,
    )
