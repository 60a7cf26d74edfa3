"""Queries for SQL texts and stored tables, and the flagship query."""

import contextlib

from pyspark.sql import functions as F

from ..operators.aggregates import group_by
from ..operators.filters import filter_range
from ..operators.joins import join_tables
from ..operators.params import row_to_params
from ..operators.rows import sort_rows
from ..session import new_path
from ..sources.batches import append_batch, read_batches
from ..sources.sql import named_queries, read_sql
from ..sources.tables import read_table, write_table
from .registry import query


@query(
    "segment_revenue",
    "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey"
    " WHERE o_totalprice BETWEEN 100000 AND 400000 GROUP BY c_mktsegment",
)
def segment_revenue(t):
    orders = filter_range(t.orders, "o_totalprice", 100000, 400000)
    joined = join_tables(orders, t.customer, "o_custkey", "c_custkey")
    sums = group_by(joined, "c_mktsegment", {"o_totalprice": "sum"})
    return sort_rows(sums.withColumn("o_totalprice", F.round("o_totalprice", 2)), "o_totalprice", False)


BY_STATUS = (
    "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders"
    " WHERE o_totalprice >= {low} AND o_orderpriority <> {skip} GROUP BY o_orderstatus"
)


@query("read_sql", BY_STATUS.format(low=1000, skip="'5-LOW'"))
def _(t):
    return read_sql(t.spark, BY_STATUS.format(low=":low", skip=":skip"), {"low": 1000, "skip": "5-LOW"}, {"orders": t.orders})


@query("named_query", "SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey")
def _(t):
    t.supplier.createOrReplaceTempView("supplier")
    catalog = {
        "all": "SELECT * FROM supplier",
        "by_nation": "SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > :low GROUP BY s_nationkey",
    }
    return named_queries(t.spark, catalog).run("by_nation", {"low": 0})


@query(
    "sql_params",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)",
)
def _(t):
    row = row_to_params(t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_custkey"))
    sql = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = $${o_custkey}$$"
    return read_sql(t.spark, sql, row, {"orders": t.orders})


@query("read_table", "SELECT * FROM part")
def _(t):
    return read_table(t.spark, "parquet", t.path("part"))


@query("write_table", "SELECT * FROM customer UNION ALL SELECT * FROM customer")
def _(t):
    """Appended twice, then read back."""
    path = new_path(t.spark, "table")
    write_table(t.customer, path)
    write_table(t.customer, path)
    return read_table(t.spark, "parquet", path)


@query("append_batch", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    """Two batches, one added twice and one broken off half-way at first: each row is there once."""
    path = new_path(t.spark, "batches")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    odd = F.col("o_orderkey") % 2 == 1
    append_batch(rows.where(odd), path, "odd")
    append_batch(rows.where(odd), path, "odd")
    broken = F.when(F.col("o_orderkey") % 10 == 8, F.raise_error(F.lit("broken off")).cast("bigint")).otherwise(F.col("o_orderkey"))
    with contextlib.suppress(Exception):
        append_batch(rows.where(~odd).withColumn("o_orderkey", broken), path, "even")
    append_batch(rows.where(~odd), path, "even")
    return read_batches(t.spark, path)
