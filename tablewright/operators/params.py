"""Parameters taken from tables, parameter sweeps, key-driven queries and lazy switches."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..missing import as_list, check_columns, order_columns, quoted, value, without_nan
from .rows import first_row


def row_to_params(df: DataFrame, order_by: Sequence[str] | str | None = None) -> dict:
    """The first row as a dict, empty for an empty table.

    This runs a job; it brings one row to the driver.
    """
    rows = (first_row(df, order_by) if order_by else df.limit(1)).collect()
    return rows[0].asDict() if rows else {}


def params_to_table(spark: SparkSession, params: Mapping, schema: T.StructType | str | None = None) -> DataFrame:
    """Parameters as a one-row table; no parameters give an empty one."""
    if not params:
        return spark.createDataFrame([], schema or T.StructType([]))
    if schema is None:
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in params.items()])
    return spark.createDataFrame([dict(params)], schema)


def with_params(df: DataFrame, params_df: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, lazily.

    The row is a scalar subquery, which fails on a second row.
    """
    row = params_df.select(F.struct("*")).scalar()
    return df.withColumns({c: row[c] for c in params_df.columns})


def param_sweep(
    df: DataFrame,
    grid: Mapping[str, Sequence] | DataFrame,
    metric: Callable[[dict], Column],
    best: str | None = None,
    width: int = 50,
) -> DataFrame:
    """Evaluate ``metric`` for each combination of parameter values.

    ``metric`` turns one combination into an aggregate column.  All combinations of
    a slice of ``width`` are aggregated in the same pass, so rows are not repeated.
    ``best`` ("max" or "min") keeps the best combination only.  ``grid`` maps names to values, or is a
    table of combinations, which come to the driver as they become expressions; for a table of thresholds use
    :func:`threshold_sweep`, which takes one pass for all.
    """
    if best not in (None, "max", "min"):
        raise ValueError("best is 'max', 'min' or None")
    if isinstance(grid, DataFrame):
        names, points = grid.columns, [row.asDict() for row in grid.distinct().collect()]
        if not points:
            return grid.select("*", F.lit(None).cast(df.agg(metric(dict.fromkeys(names))).schema[0].dataType).alias("metric"))
    else:
        names, points = list(grid), [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    out = None
    for at in range(0, len(points), width):
        part = points[at : at + width]
        wide = df.agg(*[metric(p).alias(f"m{i}") for i, p in enumerate(part)])
        rows = [
            F.struct(*[F.lit(v).alias(k) for k, v in p.items()], F.col(f"m{i}").alias("metric"))
            for i, p in enumerate(part)
        ]
        table = wide.select(F.inline(F.array(*rows)))
        out = table if out is None else out.unionByName(table)
    if best:
        order = order_columns(out, ["metric", *names], [best == "min"] + [True] * len(names))
        out = out.orderBy(*order).limit(1)
    return out


def query_by_keys(
    source: DataFrame, keys_df: DataFrame, on: Sequence[str] | str, source_on: Sequence[str] | str | None = None
) -> DataFrame:
    """Source rows whose key occurs in ``keys_df``: the loop over single-key queries as one semi join.

    ``on`` names the columns of ``keys_df``, ``source_on`` those of the source.  As in
    SQL, a missing key selects nothing.
    """
    on = as_list(on)
    pairs = list(zip(as_list(source_on) or on, on))
    check_columns(source, [s for s, _ in pairs])
    check_columns(keys_df, on)
    keys = without_nan(keys_df, on).select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(on)]).distinct()
    cond = reduce(Column.__and__, [value(source, s) == F.col(f"__k{i}") for i, (s, _) in enumerate(pairs)])
    return source.join(keys, cond, "left_semi")


def table_or_else(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """``df`` if it has rows, else ``fallback``; decided while the plan runs."""
    return df.unionByName(fallback.where(~df.limit(1).exists()))
