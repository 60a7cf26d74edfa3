"""Missing-value rules.

A missing value is NULL, or NaN in a float/double column.  Comparisons other than
"not equal" are false on a missing value, aggregates skip it, joins match missing
keys with each other and sorting puts it last.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_list(value) -> list:
    if value is None:
        return []
    if isinstance(value, (str, Column)):
        return [value]
    return list(value)


def check_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"unknown columns {absent}; the table has {df.columns}")


def type_of(df: DataFrame, name: str) -> T.DataType:
    check_columns(df, [name])
    return df.schema[name].dataType


def quoted(name: str) -> Column:
    """Column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    dtype = type_of(df, name)
    if is_float(dtype):
        return F.nanvl(quoted(name), F.lit(None).cast(dtype))
    return quoted(name)


def is_missing(df: DataFrame, name: str) -> Column:
    if is_float(type_of(df, name)):
        return quoted(name).isNull() | F.isnan(quoted(name))
    return quoted(name).isNull()


def without_nan(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Turn NaN into NULL in the named float columns, in one projection."""
    floats = {n: value(df, n) for n in names if is_float(type_of(df, n))}
    return df.withColumns(floats) if floats else df


def same_keys(pairs: Sequence[tuple[str, str]], null_safe: bool = True) -> Column:
    """Equality of key pairs; ``<=>`` is planned as hash or sort-merge keys."""
    cond = None
    for left, right in pairs:
        one = quoted(left).eqNullSafe(quoted(right)) if null_safe else quoted(left) == quoted(right)
        cond = one if cond is None else cond & one
    return cond


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def order_columns(df: DataFrame, cols, ascending=True) -> list[Column]:
    """Sort keys with missing values last in both directions."""
    cols = as_list(cols)
    flags = [ascending] * len(cols) if isinstance(ascending, bool) else list(ascending)
    if len(flags) != len(cols):
        raise ValueError("give one direction per sort column")
    return [
        value(df, c).asc_nulls_last() if up else value(df, c).desc_nulls_last()
        for c, up in zip(cols, flags)
    ]


def with_tests(df: DataFrame, conditions: Sequence[str | Column]) -> tuple[DataFrame, list[Column]]:
    """A table with the columns of ``df`` and more, and for each condition a column to read on it.

    Conditions are Spark SQL text or columns and see NaN as missing: the float columns they
    name are NULL instead of NaN for them alone.  An unknown condition is false.  Drop the
    other columns with ``select(*df.columns)``.
    """
    written = " ".join(c if isinstance(c, str) else str(c) for c in conditions).lower()
    tests = [F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)) for c in conditions]
    floats = [f.name for f in df.schema.fields if is_float(f.dataType) and f.name.lower() in written]
    if not floats:
        return df, tests
    # The conditions are put to a copy of the row without NaN; the columns themselves move along untouched.
    kept = {c: f"__kept{i}" for i, c in enumerate(floats)}
    both = [value(df, c).alias(c) if c in kept else quoted(c) for c in df.columns]
    seen = df.select(*both, *[quoted(c).alias(k) for c, k in kept.items()])
    back = [quoted(kept[c]).alias(c) if c in kept else quoted(c) for c in df.columns]
    names = [f"__test{i}" for i in range(len(tests))]
    return seen.select(*back, *[t.alias(n) for t, n in zip(tests, names)]), [F.col(n) for n in names]
