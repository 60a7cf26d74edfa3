"""Approximate distinct counts from sketches that can be stored and merged.

A sketch is a HyperLogLog summary of at most ``2 ** lg_k`` buckets in a binary column.  Sketches of parts
of a table, made at different times, merge into the sketch of the whole; tables of sketches are
small, so counts over long periods never read the rows again.  :func:`append_sketches` adds the sketches
of a batch to a stored table, once however often it is run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..missing import as_list, check_columns, quoted, value
from ..sources.batches import append_batch, read_batches

LG_K = 12


def distinct_bound(lg_k: int = LG_K, deviations: float = 3) -> float:
    """Relative error that an estimate keeps with that many standard deviations."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def sketch_of(df: DataFrame, col: str, lg_k: int = LG_K) -> Column:
    """Aggregate: sketch of the non-missing values of a column of any type but maps."""
    seen = value(df, col)
    return F.hll_sketch_agg(F.when(seen.isNotNull(), F.xxhash64(seen)), lg_k)


def approx_distinct(df: DataFrame, col: str, lg_k: int = LG_K) -> Column:
    """Aggregate: estimated number of distinct non-missing values, 0 for none."""
    return F.coalesce(F.hll_sketch_estimate(sketch_of(df, col, lg_k)), F.lit(0))


def distinct_sketches(df: DataFrame, keys: Sequence[str] | str, cols: Sequence[str] | str, lg_k: int = LG_K) -> DataFrame:
    """One row per group, missing keys included: the keys and a sketch in place of each column."""
    keys, cols = as_list(keys), as_list(cols)
    check_columns(df, [*keys, *cols])
    group = [value(df, k).alias(k) for k in keys]
    return df.groupBy(*group).agg(*[sketch_of(df, c, lg_k).alias(c) for c in cols])


def merge_sketches(sketches: DataFrame, keys: Sequence[str] | str, cols: Sequence[str] | str) -> DataFrame:
    """One row per group: the sketches of its rows merged.  ``keys`` may be fewer than those of the table."""
    keys, cols = as_list(keys), as_list(cols)
    check_columns(sketches, [*keys, *cols])
    merged = [F.hll_union_agg(quoted(c)).alias(c) for c in cols]
    return sketches.groupBy(*[quoted(k) for k in keys]).agg(*merged)


def estimate_distinct(sketches: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """The table with each sketch replaced by its estimate."""
    check_columns(sketches, as_list(cols))
    return sketches.withColumns({c: F.hll_sketch_estimate(quoted(c)) for c in as_list(cols)})


def append_sketches(
    df: DataFrame, path: str, batch: str, keys: Sequence[str] | str, cols: Sequence[str] | str, lg_k: int = LG_K
) -> bool:
    """Add the sketches of a batch of rows to the table at ``path``; False if the batch is there already."""
    return append_batch(distinct_sketches(df, keys, cols, lg_k), path, batch)


def read_sketches(spark: SparkSession, path: str, keys: Sequence[str] | str, cols: Sequence[str] | str) -> DataFrame:
    """The sketches of all batches at ``path``, merged per group."""
    return merge_sketches(read_batches(spark, path), keys, cols)
