"""Aggregates of the rows on one side of each threshold of a grid table.

The grid is a table of any size, and no row meets more than one of its thresholds:

1. each value is moved to the first threshold that keeps it, so rows are counted per interval between thresholds
   before anything is shuffled (up to ``broadcast_rows`` thresholds; with more, rows are counted per
   value);
2. thresholds and intervals are cut into ranges of their order, and running totals over the few range totals
   and inside each range give the aggregates of every threshold.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..missing import check_columns, order_columns, quoted, type_of, value
from ..session import materialize

# Which values a threshold keeps: whether it is the upper end, whether equal ones are kept.
SIDES = {"<=": (True, True), "<": (True, False), ">=": (False, True), ">": (False, False)}
PARTIAL = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _parts(df: DataFrame, metrics: Mapping[str, tuple[str, str]]) -> dict[str, tuple[str, Column]]:
    """Columns that can be added up or compared, per metric: the way to combine them and the first value."""
    out = {}
    for name, (method, col) in metrics.items():
        if method not in (*PARTIAL, "mean"):
            raise ValueError(f"a sweep takes {[*PARTIAL, 'mean']}, not {method!r}")
        check_columns(df, [col])
        seen = value(df, col)
        for kind in ("sum", "count") if method == "mean" else (method,):
            out[f"__{kind}_{name}"] = kind, F.when(seen.isNull(), 0).otherwise(1) if kind == "count" else seen
    return out


def _snapped(rows: DataFrame, points: DataFrame, upper: bool, equal: bool) -> DataFrame:
    """``rows`` with ``__at`` moved to the first threshold that keeps it; others go.  The thresholds
    are sent to all tasks as one sorted array."""
    whole = isinstance(rows.schema["__at"].dataType, T.LongType)
    sent = rows.sparkSession.sparkContext.broadcast(np.sort(points.toArrow()["__at"].to_numpy()))
    at = rows.columns.index("__at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = sent.value
        for batch in batches:
            values = batch.column(at).to_numpy(zero_copy_only=False)
            if upper:
                place = np.searchsorted(grid, values, "left" if equal else "right")
            else:
                place = np.searchsorted(grid, values, "right" if equal else "left") - 1
            kept = np.flatnonzero((place >= 0) & (place < len(grid)))
            moved = pa.array(grid[place[kept]], pa.int64() if whole else pa.float64())
            batch = batch.take(pa.array(kept))
            yield batch.set_column(at, batch.schema.field(at), moved)

    return rows.mapInArrow(run, rows.schema)


def threshold_sweep(
    df: DataFrame,
    col: str,
    grid: DataFrame,
    threshold: str,
    metrics: Mapping[str, tuple[str, str]],
    keep: str = "<=",
    broadcast_rows: int = 1 << 20,
) -> DataFrame:
    """``grid`` with a column per metric: the aggregate of the rows with ``col keep threshold``.

    ``metrics`` maps names to (method, column), methods being sum, count, min, max and mean.
    ``keep`` is one of <=, <, >= and >.  Missing values are kept by no threshold, a missing threshold keeps
    nothing.  The sum and the count of nothing are 0, other aggregates missing.  Writes
    intermediate tables.
    """
    if keep not in SIDES:
        raise ValueError(f"keep is one of {list(SIDES)}, not {keep!r}")
    check_columns(df, [col])
    check_columns(grid, [threshold])
    clash = set(metrics) & set(grid.columns)
    if clash:
        raise ValueError(f"the grid has columns {sorted(clash)} already")
    upper, equal = SIDES[keep]
    integral = all(isinstance(type_of(x, c), T.IntegralType) for x, c in ((df, col), (grid, threshold)))
    kind = "bigint" if integral else "double"
    parts = _parts(df, metrics)
    rows = df.select(value(df, col).cast(kind).alias("__at"), *[first.alias(n) for n, (_, first) in parts.items()])
    rows = rows.where("__at IS NOT NULL")
    points = grid.select(value(grid, threshold).cast(kind).alias("__at")).where("__at IS NOT NULL").distinct()
    points = materialize(points, "thresholds")
    if points.count() <= broadcast_rows:
        rows, equal = _snapped(rows, points, upper, equal), True
    combined = rows.groupBy("__at").agg(*[PARTIAL[how](n).alias(n) for n, (how, _) in parts.items()])

    # A threshold comes after the values that it keeps.
    place = F.lit(1 if equal else -1).alias("__place")
    empty = [F.lit(None).cast(combined.schema[n].dataType).alias(n) for n in parts]
    both = combined.withColumn("__place", F.lit(0)).unionByName(points.select("__at", place, *empty))
    order = order_columns(both, ["__at", "__place"], [upper, True])
    cut = both.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    cut = materialize(cut, "sweep")
    totals = cut.groupBy("__part").agg(*[PARTIAL[how](n).alias(n) for n, (how, _) in parts.items()])
    # One row per range.
    before = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("__part", *[PARTIAL[how](n).over(before).alias(f"{n}_") for n, (how, _) in parts.items()])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = cut.select("__at", "__place", "__part", *[PARTIAL[how](n).over(inside).alias(n) for n, (how, _) in parts.items()])
    reached = running.where(F.col("__place") != 0).join(earlier, "__part")

    def joined(name: str) -> Column:
        how = parts[name][0]
        if how in ("sum", "count"):
            return F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"{name}_"), F.lit(0))
        return (F.least if how == "min" else F.greatest)(F.col(name), F.col(f"{name}_"))  # these skip NULL

    out = {}
    for name, (method, _) in metrics.items():
        if method == "mean":
            n = joined(f"__count_{name}")
            out[name] = F.when(n > 0, joined(f"__sum_{name}") / n)
        else:
            out[name] = joined(f"__{method}_{name}")
    found = reached.select("__at", *[v.alias(n) for n, v in out.items()])
    matched = grid.join(found, value(grid, threshold).cast(kind) == F.col("__at"), "left").drop("__at")
    zero = {n: F.coalesce(quoted(n), F.lit(0)) for n, (method, _) in metrics.items() if method in ("sum", "count")}
    return matched.withColumns(zero) if zero else matched
