"""Queries for joins, key-driven queries, parameters and table switches."""

from pyspark.sql import functions as F

from ..operators.aggregates import group_by
from ..operators.joins import join_by_flags, join_tables
from ..operators.params import (
    param_sweep,
    params_to_table,
    query_by_keys,
    row_to_params,
    table_or_else,
    with_params,
)
from ..operators.sweeps import threshold_sweep
from .registry import query


def customers(t):
    return t.customer.select(F.col("c_custkey").alias("custkey"), "c_name", "c_mktsegment")


# A seventh of the orders gets a customer key that no customer has.
ORDER_KEY = "CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END"


def keyed_orders(t):
    return t.orders.select(F.expr(ORDER_KEY).alias("custkey"), "o_orderkey", "o_totalprice")


CUST = "(SELECT c_custkey AS custkey, c_name, c_mktsegment FROM customer) AS c"
ORD = f"(SELECT {ORDER_KEY} AS custkey, o_orderkey, o_totalprice FROM orders) AS o"
JOINED = "custkey, c_name, c_mktsegment, o_orderkey, o_totalprice"


@query(
    "join_inner",
    "SELECT o_orderkey AS orderkey, o_custkey, o_orderdate, l_quantity, l_extendedprice"
    " FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
)
def _(t):
    left = t.orders.select(F.col("o_orderkey").alias("orderkey"), "o_custkey", "o_orderdate")
    right = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), "l_quantity", "l_extendedprice")
    return join_tables(left, right, "orderkey")


@query("join_left", f"SELECT {JOINED} FROM {CUST} LEFT JOIN {ORD} USING (custkey)")
def _(t):
    return join_tables(customers(t), keyed_orders(t), "custkey", how="left")


@query("join_right", f"SELECT {JOINED} FROM {CUST} RIGHT JOIN {ORD} USING (custkey)")
def _(t):
    return join_tables(customers(t), keyed_orders(t), "custkey", how="right")


@query("join_outer", f"SELECT {JOINED} FROM {CUST} FULL JOIN {ORD} USING (custkey)")
def _(t):
    return join_tables(customers(t), keyed_orders(t), "custkey", how="outer")


@query(
    "join_null_keys",
    "SELECT c.nationkey, c_custkey, n_name FROM (SELECT nullif(c_nationkey, 3) AS nationkey, c_custkey FROM customer) AS c"
    " JOIN (SELECT nullif(n_nationkey, 3) AS nationkey, n_name FROM nation) AS n ON c.nationkey IS NOT DISTINCT FROM n.nationkey",
)
def _(t):
    left = t.customer.select(F.expr("nullif(c_nationkey, 3)").alias("nationkey"), "c_custkey")
    right = t.nation.select(F.expr("nullif(n_nationkey, 3)").alias("nationkey"), "n_name")
    return join_tables(left, right, "nationkey")


@query("join_diff_keys", "SELECT c_custkey, c_nationkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    left = t.customer.select("c_custkey", "c_nationkey")
    return join_tables(left, t.nation.select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey")


@query("join_natural", "SELECT s_nationkey AS nationkey, s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    left = t.supplier.select(F.col("s_nationkey").alias("nationkey"), "s_suppkey")
    return join_tables(left, t.nation.select(F.col("n_nationkey").alias("nationkey"), "n_name"))


@query("join_left_anti", f"SELECT {JOINED} FROM {CUST} LEFT JOIN {ORD} USING (custkey) WHERE o_orderkey IS NULL")
def _(t):
    return join_by_flags(customers(t), keyed_orders(t), "custkey", matches=False, left_unmatched=True)


@query(
    "join_sym_diff",
    f"SELECT {JOINED} FROM {CUST} FULL JOIN {ORD} USING (custkey)"
    " WHERE o_orderkey IS NULL OR c_name IS NULL",
)
def _(t):
    left = customers(t)
    return join_by_flags(left, keyed_orders(t), "custkey", None, False, True, True)


@query(
    "join_self",
    "SELECT a.o_orderkey, a.o_custkey AS o_custkey_x, a.o_totalprice AS o_totalprice_x,"
    " a.o_custkey AS o_custkey_y, a.o_totalprice AS o_totalprice_y FROM orders a",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return join_tables(df, df, "o_orderkey")


@query(
    "join_suffix",
    "SELECT o.o_custkey, o.o_orderkey AS o_orderkey_x, o.o_totalprice AS o_totalprice_x,"
    " m.k AS o_orderkey_y, m.p AS o_totalprice_y FROM orders o JOIN (SELECT o_custkey,"
    " min(o_orderkey) AS k, max(o_totalprice) AS p FROM orders GROUP BY o_custkey) m ON o.o_custkey = m.o_custkey",
)
def _(t):
    df = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return join_tables(df, group_by(df, "o_custkey", {"o_orderkey": "min", "o_totalprice": "max"}), "o_custkey")


# -- parameters

@query("params_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
def _(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    row = row_to_params(df.orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")))
    return params_to_table(t.spark, row, df.schema)


@query(
    "param_broadcast",
    "SELECT o_orderkey, o_totalprice, (SELECT max(o_totalprice) FROM orders) AS top,"
    " (SELECT min(o_orderdate) FROM orders) AS since FROM orders",
)
def _(t):
    params = t.orders.agg(F.max("o_totalprice").alias("top"), F.min("o_orderdate").alias("since"))
    return with_params(t.orders.select("o_orderkey", "o_totalprice"), params)


@query(
    "param_sweep",
    "SELECT d, cap, round(sum(CASE WHEN l_quantity <= cap THEN l_extendedprice * (1 - d) ELSE 0 END), 2) AS metric FROM lineitem,"
    " (SELECT unnest([0.0, 0.25, 0.5])::DOUBLE AS d), (SELECT unnest([10, 30])::INTEGER AS cap) GROUP BY d, cap",
)
def _(t):
    return param_sweep(
        t.lineitem,
        {"d": [0.0, 0.25, 0.5], "cap": [10, 30]},
        lambda p: F.round(
            F.sum(F.when(F.col("l_quantity") <= p["cap"], F.col("l_extendedprice") * (1 - F.lit(p["d"]))).otherwise(0)), 2
        ),
    )


@query(
    "param_sweep_best",
    "SELECT q, CAST(count(*) FILTER (WHERE l_quantity > q) AS BIGINT) AS metric FROM lineitem,"
    " (SELECT unnest([10, 20, 40])::INTEGER AS q) GROUP BY q ORDER BY metric DESC, q LIMIT 1",
)
def _(t):
    return param_sweep(t.lineitem, {"q": [10, 20, 40]}, lambda p: F.count_if(F.col("l_quantity") > p["q"]), "max")


@query(
    "threshold_sweep",
    "SELECT o_orderkey, o_totalprice, CAST(n AS BIGINT) AS n, CAST(coalesce(cents, 0) AS BIGINT) AS cents, top, round(mean, 6) AS mean"
    " FROM (SELECT o_orderkey, v AS o_totalprice, count(l_quantity) OVER w AS n, sum(c) OVER w AS cents, max(l_quantity) OVER w AS top,"
    " avg(l_quantity) OVER w AS mean FROM (SELECT NULL AS o_orderkey, l_extendedprice AS v, l_quantity,"
    " CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem"
    " UNION ALL SELECT o_orderkey, o_totalprice, NULL, NULL FROM orders)"
    " WINDOW w AS (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE o_orderkey IS NOT NULL",
)
def _(t):
    """Lines up to the price of each order: as many thresholds as orders, one pass over the lines."""
    lines = t.lineitem.select(
        "l_extendedprice", "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c")
    )
    metrics = {"n": ("count", "l_quantity"), "cents": ("sum", "c"), "top": ("max", "l_quantity"), "mean": ("mean", "l_quantity")}
    found = threshold_sweep(lines, "l_extendedprice", t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", metrics)
    return found.withColumn("mean", F.round("mean", 6))


@query(
    "param_sweep_table",
    "SELECT n_name, n_nationkey, CAST(count(*) FILTER (WHERE c_nationkey > n_nationkey) AS BIGINT) AS metric"
    " FROM customer, nation GROUP BY ALL",
)
def _(t):
    grid = t.nation.select("n_name", "n_nationkey")
    return param_sweep(t.customer, grid, lambda p: F.count_if(F.col("c_nationkey") > F.lit(p["n_nationkey"])))


@query(
    "db_loop_semi",
    "SELECT * FROM lineitem WHERE l_partkey * 7 IN (SELECT o_orderkey FROM orders)",
)
def _(t):
    source = t.lineitem.withColumn("asked", F.col("l_partkey") * 7)
    return query_by_keys(source, t.orders, "o_orderkey", "asked").drop("asked")


@query(
    "db_loop_nan",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice IN"
    " (SELECT o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 2 = 0)",
)
def _(t):
    nan = "CASE WHEN o_orderstatus = 'P' THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END"
    df = t.orders.select("o_orderkey", F.expr(nan).alias("o_totalprice"))
    keys = df.select(F.expr("CASE WHEN o_orderkey % 2 = 0 OR isnan(o_totalprice) THEN o_totalprice END").alias("k"))
    return query_by_keys(df, keys, "k", "o_totalprice")


@query("empty_switch", "SELECT c_custkey AS id, c_name AS name FROM customer")
def _(t):
    none = t.orders.where("o_totalprice < 0").selectExpr("o_orderkey AS id", "o_orderpriority AS name")
    return table_or_else(none, t.customer.selectExpr("c_custkey AS id", "c_name AS name"))


@query("empty_switch_filled", "SELECT o_orderkey AS id, o_orderpriority AS name FROM orders")
def _(t):
    some = t.orders.selectExpr("o_orderkey AS id", "o_orderpriority AS name")
    return table_or_else(some, t.customer.selectExpr("c_custkey AS id", "c_name AS name"))
