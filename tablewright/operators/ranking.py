"""Positions in a total order, without a task that sees a whole group.

Rows are cut into ranges of (group, order) and stored; the weights of the ranges are
summed first, and only the small table of range totals is accumulated across ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..missing import order_columns, quoted, same_keys
from ..session import materialize

PART = "__part"
BEFORE = "__before"
SIZE = "__size"


def weights_before(
    df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str, ascending=True, null_keys: bool = True
) -> DataFrame:
    """Add ``__before``, the weight of all earlier rows of the same ``by`` group, and
    ``__size``, the weight of the whole group.

    ``order`` must identify the rows of a group; then the ranges even out however large
    one group is.  Their number is that of the session's shuffle partitions, which
    adaptive execution lowers for small data.  Say ``null_keys=False`` where ``by`` holds no
    NULL: plain equality lets the join of the totals keep the partitioning of the window.
    """
    sort = [*order_columns(df, list(by)), *order_columns(df, list(order), ascending)]
    cut = materialize(df.repartitionByRange(*sort).withColumn(PART, F.spark_partition_id()), "ranges")

    totals = cut.groupBy(*[quoted(b) for b in by], PART).agg(F.sum(weight).alias("__total"))
    # A group has at most one total per range, so a window holds at most one row per shuffle partition.
    group = Window.partitionBy(*[quoted(b) for b in by])
    earlier = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[quoted(b).alias(f"__by{i}") for i, b in enumerate(by)],
        F.col(PART).alias("__at"),
        F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"),
        F.sum("__total").over(group).alias(SIZE),
    )

    local = (
        Window.partitionBy(PART, *[quoted(b) for b in by])
        .orderBy(*order_columns(cut, list(order), ascending))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = cut.withColumn("__inside", F.coalesce(F.sum(weight).over(local), F.lit(0)))
    on = F.col(PART) == F.col("__at")
    if by:
        on &= same_keys([(b, f"__by{i}") for i, b in enumerate(by)], null_safe=null_keys)
    return inside.join(offsets, on).select(
        *[quoted(c) for c in df.columns], (F.col("__offset") + F.col("__inside")).alias(BEFORE), SIZE
    )


def unique_positions(df: DataFrame, order: Sequence[str], ascending=True) -> DataFrame:
    """Add ``__before``, the 0-based position of each row, with a single shuffle.

    The position inside a range is stored with the row; ranges even out only if
    ``order`` takes many values.
    """
    sort = order_columns(df, list(order), ascending)
    address = F.monotonically_increasing_id()  # range number in the upper bits, position in the lower 33
    stored = materialize(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__address", address),
        "positions",
    )
    part = F.shiftright("__address", 33)
    counts = stored.groupBy(part.alias("__at")).count()
    # One row per range: no more rows than shuffle partitions are accumulated and broadcast.
    earlier = Window.partitionBy().orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__at", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__offset"))
    position = F.col("__offset") + F.col("__address").bitwiseAND((1 << 33) - 1)
    return stored.join(F.broadcast(offsets), part == F.col("__at")).select(
        *[quoted(c) for c in df.columns], position.alias(BEFORE)
    )
