"""Queries for column selection, row filters, sorting, numbering and concatenation."""

from pyspark.sql import functions as F

from ..operators.columns import constant_column, keep_columns, rename_columns, reorder_columns
from ..operators.filters import (
    filter_ci,
    filter_equals,
    filter_has_value,
    filter_missing,
    filter_range,
    rule_filter,
    split_rows,
)
from ..operators.params import row_to_params
from ..operators.rows import (
    add_empty_rows,
    concat_tables,
    counter,
    date_range,
    drop_duplicate_rows,
    fill_missing,
    first_row,
    sort_rows,
    top_n,
)
from .registry import query


def with_gaps(t):
    """Orders whose status P is missing."""
    return t.orders.withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))


GAPS = (
    "(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice,"
    " o_orderdate, o_orderpriority FROM orders) AS g"
)


# -- columns

@query("column_filter", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return keep_columns(t.orders, ["o_orderkey", "o_totalprice"])


@query("column_rename", "SELECT c_custkey AS customer, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    return rename_columns(t.customer, {"c_custkey": "customer", "c_name": "name", "absent": "x"})


@query("column_reorder", "SELECT p_name, p_partkey FROM part")
def _(t):
    return reorder_columns(t.part, ["p_name", "p_partkey"])


@query("constant_column", "SELECT p_partkey, CAST(7 AS BIGINT) AS k, 'x' AS label, CAST(0.5 AS DOUBLE) AS rate FROM part")
def _(t):
    df = constant_column(keep_columns(t.part, ["p_partkey"]), "k", 7, "int")
    return constant_column(constant_column(df, "label", "x"), "rate", 0.5, "double")


# -- filters

@query("row_filter_eq", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return filter_equals(t.orders, "o_orderstatus", "F")


@query("row_filter_ne", f"SELECT * FROM {GAPS} WHERE o_orderstatus IS DISTINCT FROM 'F'")
def _(t):
    return filter_equals(with_gaps(t), "o_orderstatus", "F", include=False)


@query("row_filter_range", "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-12-31'")
def _(t):
    return filter_range(t.lineitem, "l_shipdate", "1996-01-01", "1996-12-31")


@query(
    "row_filter_not_range",
    "SELECT o_orderkey, nullif(o_totalprice, 0) AS p, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price"
    " FROM orders WHERE NOT coalesce(o_orderstatus <> 'P' AND o_totalprice BETWEEN 100000 AND 300000, false)",
)
def _(t):
    df = t.orders.select(
        "o_orderkey",
        F.col("o_totalprice").alias("p"),
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END").alias("price"),
    )
    return filter_range(df, "price", 100000, 300000, include=False)


@query("row_filter_missing", f"SELECT * FROM {GAPS} WHERE o_orderstatus IS NULL")
def _(t):
    return filter_missing(with_gaps(t), "o_orderstatus")


@query("row_filter_has_value", f"SELECT * FROM {GAPS} WHERE o_orderstatus IS NOT NULL")
def _(t):
    return filter_has_value(with_gaps(t), "o_orderstatus")


@query("row_split_match", "SELECT * FROM part WHERE p_size >= 25")
def _(t):
    return split_rows(t.part, "p_size", "GTE", "25")[0]


@query("row_split_rest", f"SELECT * FROM {GAPS} WHERE NOT coalesce(o_orderstatus = 'F', false)")
def _(t):
    return split_rows(with_gaps(t), "o_orderstatus", "EQ", "F")[1]


@query("row_split_neq", f"SELECT * FROM {GAPS} WHERE o_orderstatus IS DISTINCT FROM 'F'")
def _(t):
    return split_rows(with_gaps(t), "o_orderstatus", "NEQ", "F")[0]


@query("row_split_like", "SELECT * FROM part WHERE regexp_matches(p_name, '^(red|small) .*(ing|et)$')")
def _(t):
    return split_rows(t.part, "p_name", "LIKE", "^(red|small) .*(ing|et)$")[0]


@query(
    "rule_filter",
    f"SELECT * FROM {GAPS} WHERE coalesce(o_totalprice > 400000 AND o_orderstatus = 'O', false)"
    " OR NOT coalesce(o_orderstatus = 'F' OR o_totalprice < 450000, false)",
)
def _(t):
    return rule_filter(
        with_gaps(t),
        [
            ("o_totalprice > 400000 AND o_orderstatus = 'O'", True),
            ("o_orderstatus = 'F' OR o_totalprice < 450000", False),
        ],
    )


@query("filter_ci", "SELECT * FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(t):
    return filter_ci(t.customer, "c_mktsegment", "Building")


# -- rows

@query("sorter", "SELECT * FROM orders")
def _(t):
    return sort_rows(t.orders, ["o_orderstatus", "o_totalprice"], [True, False])


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def _(t):
    return drop_duplicate_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_shipdate"))


@query(
    "distinct_subset",
    "SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER"
    " (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1",
)
def _(t):
    df = t.events.select("event_id", "user_id", "event_type", "value")
    return drop_duplicate_rows(df, ["user_id", "event_type"], order_by="event_id")


@query("row_counter", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey DESC) AS counter FROM orders")
def _(t):
    return counter(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", ascending=False, unique=True)


@query(
    "row_counter_copies",
    "SELECT l_quantity, l_returnflag, l_linestatus, row_number() OVER"
    " (ORDER BY l_quantity, l_returnflag, l_linestatus) AS counter FROM lineitem",
)
def _(t):
    return counter(t.lineitem.select("l_quantity", "l_returnflag", "l_linestatus"), "l_quantity")


@query("add_empty_rows", "SELECT * FROM customer UNION ALL SELECT NULL, NULL, NULL, NULL, NULL FROM range(3)")
def _(t):
    return add_empty_rows(t.customer, 3)


@query("top_n", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return top_n(t.orders, 20, ["o_totalprice", "o_orderkey"], [False, True])


@query("first_row", "SELECT * FROM events ORDER BY ts, event_id LIMIT 1")
def _(t):
    return first_row(t.events, ["ts", "event_id"])


@query(
    "date_range",
    "SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS date FROM"
    " (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders)",
)
def _(t):
    ends = row_to_params(t.orders.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi")))
    return date_range(t.spark, ends["lo"], ends["hi"])


@query(
    "fill_missing",
    "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') AS o_orderstatus,"
    " coalesce(CASE WHEN o_totalprice > 100000 THEN o_totalprice END, 0) AS price FROM orders",
)
def _(t):
    df = with_gaps(t).select(
        "o_orderkey", "o_orderstatus", F.expr("CASE WHEN o_totalprice > 100000 THEN o_totalprice END").alias("price")
    )
    return fill_missing(fill_missing(df, 0), {"o_orderstatus": "?"})


# -- concatenation

@query("concat_two", "SELECT * FROM orders UNION ALL SELECT * FROM orders")
def _(t):
    return concat_tables(t.orders, t.orders)


@query(
    "concat_missing_cols",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer"
    " UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier"
    " UNION ALL SELECT n_nationkey, n_name, NULL, NULL FROM nation",
)
def _(t):
    a = t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS acctbal", "c_mktsegment AS segment")
    b = t.supplier.selectExpr("s_acctbal AS acctbal", "s_suppkey AS id", "s_name AS name")
    return concat_tables(a, b, t.nation.selectExpr("n_name AS name", "n_nationkey AS id"))
