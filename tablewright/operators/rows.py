"""Sorting, de-duplication, numbering, row generation, filling and concatenation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..missing import as_list, check_columns, numeric_columns, order_columns, quoted, without_nan
from .ranking import BEFORE, unique_positions, weights_before

COPIES = 16  # copies that one row stands for while rows are ordered


def sort_rows(
    df: DataFrame, cols: Sequence[str] | str, ascending: bool | Sequence[bool] = True, copies: bool = False
) -> DataFrame:
    """Sort by several keys, a direction per key, missing values last.

    Rows with equal keys are ordered by a hash of the row, so the range shuffle can
    spread a key value that many rows share.  With ``copies=True`` copies of one row are
    spread too, by their place in the task; a local sort makes that place the same in a
    repeated task.
    """
    check_columns(df, as_list(cols))
    order = order_columns(df, cols, ascending)
    hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    spread = df.withColumn("__hash", F.xxhash64(*[quoted(c) for c in hashed]))
    if copies:
        spread = spread.sortWithinPartitions("__hash").withColumn("__place", F.monotonically_increasing_id())
        order = [*order, F.col("__hash"), F.col("__place")]
    else:
        order = [*order, F.col("__hash")]
    return spread.orderBy(*order).select(*[quoted(c) for c in df.columns])


def drop_duplicate_rows(
    df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] | str | None = None
) -> DataFrame:
    """One row per distinct row, or per distinct ``subset``; missing equals missing.

    With ``subset``, ``order_by`` makes the first row in that order the one kept.
    """
    df_ = without_nan(df, subset or df.columns)
    if not subset or set(subset) == set(df.columns):
        return df_.distinct()
    check_columns(df, subset)
    if not order_by:
        return df_.dropDuplicates(list(subset))
    place = F.struct(*[quoted(o) for o in as_list(order_by)])
    rest = [c for c in df.columns if c not in subset]
    first = F.min_by(F.struct(*[quoted(c) for c in rest]), place).alias("__row")
    return df_.groupBy(*[quoted(c) for c in subset]).agg(first).select(
        *[quoted(c) if c in subset else F.col("__row")[c].alias(c) for c in df.columns]
    )


def counter(
    df: DataFrame,
    order_by: Sequence[str] | str,
    name: str = "counter",
    start: int = 1,
    ascending: bool | Sequence[bool] = True,
    unique: bool = False,
) -> DataFrame:
    """Number the rows ``start``, ``start`` + 1, … in the given order.

    Copies of one row are counted before they are ordered and ordered as rows of COPIES copies, so any
    number of them stays spread out.  Say ``unique=True`` where ``order_by`` identifies the rows: the
    copies step is then left out, and the numbers cost one shuffle.
    """
    order_by = as_list(order_by)
    check_columns(df, order_by)
    number = lambda position: (position + F.lit(start)).cast("bigint").alias(name)
    keep = [quoted(c) for c in df.columns if c != name]
    # Maps cannot be compared, so copies of rows that hold one cannot be counted.
    incomparable = any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema.fields)
    if unique or incomparable:
        return unique_positions(df, order_by, ascending).select(*keep, number(F.col(BEFORE)))

    flags = [ascending] * len(order_by) if isinstance(ascending, bool) else list(ascending)
    ties = [c for c in df.columns if c not in order_by]
    copies = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("__copies"))
    # A row that stands for many copies is ordered as many rows of COPIES each, so ranges of rows are about even.
    several = copies.withColumn("__from", F.explode(F.expr(f"sequence(0L, __copies - 1, {COPIES}L)")))
    several = several.withColumn("__n", F.least(F.col("__copies") - F.col("__from"), F.lit(COPIES))).drop("__copies")
    order = [*order_by, *ties, "__from"]
    placed = weights_before(several, [], order, "__n", flags + [True] * (len(ties) + 1))
    unfolded = placed.withColumn("__copy", F.explode(F.expr("sequence(0L, __n - 1)")))
    return unfolded.select(*keep, number(F.col(BEFORE) + F.col("__copy")))


def add_empty_rows(df: DataFrame, n: int = 1) -> DataFrame:
    """Append ``n`` rows whose columns are all missing."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.unionByName(df.sparkSession.range(n).select(*nulls))


def top_n(
    df: DataFrame, n: int, order_by: Sequence[str] | str, ascending: bool | Sequence[bool] = True
) -> DataFrame:
    """The first ``n`` rows in the given order; each task keeps ``n`` rows."""
    check_columns(df, as_list(order_by))
    return df.orderBy(*order_columns(df, order_by, ascending)).limit(n)


def first_row(df: DataFrame, order_by: Sequence[str] | str, ascending: bool | Sequence[bool] = True) -> DataFrame:
    return top_n(df, 1, order_by, ascending)


def date_range(spark: SparkSession, start, end, name: str = "date") -> DataFrame:
    """One row per day from ``start`` to ``end``, both included."""
    start, end = (dt.datetime.fromisoformat(str(t)) for t in (start, end))
    days = (end - start).days
    shifted = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))
    return spark.range(max(days + 1, 0)).select(shifted.alias(name))


def fill_missing(df: DataFrame, value=0, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace missing values by a constant, or by one constant per column of a dict.

    Without ``cols`` a number fills the numeric columns and a text the text columns.
    """
    if isinstance(value, Mapping):
        check_columns(df, value)
        return df.fillna(dict(value))
    if cols is None:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        cols = texts if isinstance(value, str) else numeric_columns(df)
    check_columns(df, cols)
    return df.fillna(value, subset=list(cols)) if cols else df


def _common_type(types: Sequence[T.DataType]) -> T.DataType:
    """Type that holds the values of all inputs of a concatenated column."""
    first = types[0]
    if all(t == first for t in types):
        return first
    if all(isinstance(t, T.IntegralType) for t in types):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in types):
        return T.TimestampNTZType()
    return T.StringType()


def concat_tables(*dfs: DataFrame) -> DataFrame:
    """All rows of all tables by column name; absent columns become missing."""
    if len(dfs) == 1:
        return dfs[0]
    names = list(dict.fromkeys(c for df in dfs for c in df.columns))
    types = {n: _common_type([df.schema[n].dataType for df in dfs if n in df.columns]) for n in names}
    same = [
        df.select(
            *[
                (quoted(n) if n in df.columns else F.lit(None)).cast(types[n]).alias(n)
                for n in names
            ]
        )
        for df in dfs
    ]
    return reduce(DataFrame.union, same)
