"""Row filters and splitters with two-valued comparison rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..missing import is_float, is_missing, quoted, type_of, with_tests

# Comparison names of the row splitter.
SPLIT_OPERATORS = ("EQ", "NEQ", "LT", "LTE", "GT", "GTE", "LIKE")


def _literal(value, dtype: T.DataType) -> Column:
    """Literal comparable with a column of ``dtype``; text is parsed by the column type.

    The column itself is never cast, so the comparison can reach the file scan.
    """
    if isinstance(value, Column) or not isinstance(value, str) or isinstance(dtype, T.StringType):
        return value if isinstance(value, Column) else F.lit(value)
    if isinstance(dtype, T.IntegralType):
        number = float(value)
        return F.lit(int(number) if number.is_integer() else number)
    return F.lit(value).cast(dtype)


def filter_equals(df: DataFrame, col: str, value, include: bool = True) -> DataFrame:
    """Rows equal to ``value``; ``include=False`` keeps the others, missing ones too."""
    literal = _literal(value, type_of(df, col))
    if include:
        return df.filter(quoted(col) == literal)
    return df.filter(~quoted(col).eqNullSafe(literal))


def in_range(df: DataFrame, col: str, lower=None, upper=None) -> Column:
    if lower is None and upper is None:
        raise ValueError("give a lower bound, an upper bound or both")
    dtype = type_of(df, col)
    tests = []
    if lower is not None:
        tests.append(quoted(col) >= _literal(lower, dtype))
    if upper is not None:
        tests.append(quoted(col) <= _literal(upper, dtype))
    if is_float(dtype):
        tests.append(~F.isnan(quoted(col)))  # NaN sorts above every number
    return reduce(Column.__and__, tests)


def filter_range(df: DataFrame, col: str, lower=None, upper=None, include: bool = True) -> DataFrame:
    """Rows within inclusive bounds; ``include=False`` keeps the complement."""
    inside = in_range(df, col, lower, upper)
    return df.filter(inside if include else ~F.coalesce(inside, F.lit(False)))


def filter_missing(df: DataFrame, col: str, include: bool = True) -> DataFrame:
    """Rows where ``col`` is missing, or with ``include=False`` those where it is not."""
    missing = is_missing(df, col)
    return df.filter(missing if include else ~missing)


def filter_has_value(df: DataFrame, col: str) -> DataFrame:
    return filter_missing(df, col, include=False)


def split_condition(df: DataFrame, col: str, op: str | None = None, value=None, literal: bool = False) -> Column:
    """Two-valued condition of the row splitter."""
    if not op:
        return ~is_missing(df, col)
    if op == "LIKE":
        text = quoted(col).cast("string")
        test = text.contains(value) if literal else text.rlike(value)
        return F.coalesce(test, F.lit(False))
    dtype = type_of(df, col)
    other, column = _literal(value, dtype), quoted(col)
    if op == "NEQ":
        return ~column.eqNullSafe(other)
    tests = {
        "LT": column < other,
        "LTE": column <= other,
        "GT": column > other,
        "GTE": column >= other,
    }
    test = tests.get(op, column == other)
    if is_float(dtype):
        test = test & ~F.isnan(column)
    return F.coalesce(test, F.lit(False))


def split_rows(
    df: DataFrame, col: str, op: str | None = None, value=None, literal: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(matching rows, remaining rows); together they are the whole input.

    ``op`` is one of :data:`SPLIT_OPERATORS`; without it, rows with a value match.
    Any other name compares for equality.  ``LIKE`` searches a regular expression,
    or the plain text with ``literal=True``.
    """
    test = split_condition(df, col, op, value, literal)
    return df.filter(test), df.filter(~test)


def rule_filter(df: DataFrame, rules: Sequence[tuple[str | Column, bool]]) -> DataFrame:
    """Keep rows for which any rule holds.

    ``(cond, True)`` holds where the condition is true, ``(cond, False)`` where it
    is not.  Conditions are Spark SQL text or columns, and see NaN as missing; an unknown
    condition is false.
    """
    if not rules:
        return df
    tested, tests = with_tests(df, [cond for cond, _ in rules])
    held = [test if keep else ~test for test, (_, keep) in zip(tests, rules)]
    return tested.filter(reduce(Column.__or__, held)).select(*[quoted(c) for c in df.columns])


def filter_ci(df: DataFrame, col: str, name: str) -> DataFrame:
    """Rows whose text equals ``name`` without regard to case."""
    return df.filter(F.lower(quoted(col)) == F.lower(F.lit(name)))
