"""Conditional, arithmetic and type-changing columns.

Conditions and formulas are Spark SQL text or columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..missing import as_list, check_columns, numeric_columns, quoted, type_of, value, with_tests
from ..operators.rows import counter

DEFAULT_TEXT = "Unknown"


def _condition(cond: str | Column) -> Column:
    return F.expr(cond) if isinstance(cond, str) else cond


def _outcome(outcome) -> Column:
    return outcome if isinstance(outcome, Column) else F.lit(outcome)


def rule_column(
    df: DataFrame, name: str, rules: Sequence[tuple[str | Column, object]], default=None
) -> DataFrame:
    """Column by ordered rules ``(condition, outcome)``; the first true condition wins.

    A condition ``"TRUE"`` or ``"FALSE"`` sets the default instead.  Outcomes are literals
    or columns.  Without a default, text outcomes fall back to "Unknown" and others
    to missing.
    """
    chosen = []
    for cond, outcome in rules:
        if isinstance(cond, str) and cond.strip().upper() in ("TRUE", "FALSE"):
            default = outcome
        else:
            chosen.append((cond, outcome))
    if not chosen:
        return df.withColumn(name, _outcome(DEFAULT_TEXT if default is None else default))
    outcomes = [_outcome(o) for _, o in chosen]
    texts = _are_texts(df, outcomes if default is None else [*outcomes, _outcome(default)])
    if default is None and all(texts):
        default = DEFAULT_TEXT
    *outcomes, default = _one_kind([*outcomes, _outcome(default)], any(texts))
    tested, tests = with_tests(df, [c for c, _ in chosen])
    chain = F.when(tests[0], outcomes[0])
    for test, outcome in zip(tests[1:], outcomes[1:]):
        chain = chain.when(test, outcome)
    return _named(df, tested, {name: chain.otherwise(default)})


def _are_texts(df: DataFrame, outcomes: Sequence[Column]) -> list[bool]:
    fields = df.select(*[o.alias(f"c{i}") for i, o in enumerate(outcomes)]).schema.fields
    return [isinstance(f.dataType, T.StringType) for f in fields]


def _one_kind(outcomes: Sequence[Column], texts: bool) -> list[Column]:
    """The outcomes, all as text if one of them is text."""
    return [o.cast("string") for o in outcomes] if texts else list(outcomes)


def _named(df: DataFrame, tested: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with the columns, which may read the tests."""
    names = [*df.columns, *[n for n in columns if n not in df.columns]]
    return tested.select(*[columns[n].alias(n) if n in columns else quoted(n) for n in names])


def if_else_columns(df: DataFrame, cond: str | Column, outputs: Mapping[str, tuple]) -> DataFrame:
    """Several columns by one condition: ``{name: (then, else)}``, a ``None`` branch is 0, or "0"
    beside a text."""
    pairs = {name: [F.lit(0) if b is None else _outcome(b) for b in pair] for name, pair in outputs.items()}
    texts = _are_texts(df, [o for pair in pairs.values() for o in pair])
    tested, (test,) = with_tests(df, [cond])
    columns = {}
    for i, (name, pair) in enumerate(pairs.items()):
        then, other = _one_kind(pair, any(texts[2 * i : 2 * i + 2]))
        columns[name] = F.when(test, then).otherwise(other)
    return _named(df, tested, columns)


def math_column(df: DataFrame, name: str, expr: str | Column) -> DataFrame:
    """Add or replace a column by a formula; write powers as ``pow(a, b)``."""
    if isinstance(expr, str) and "^" in expr:
        raise ValueError("'^' is a bit operation in SQL: write pow(a, b)")
    return df.withColumn(name, _condition(expr))


def power(base, exponent) -> Column:
    return F.pow(base, exponent)


def math_if(cond: str | Column, then, other) -> Column:
    """A column by one condition, which sees the columns as they are; for conditions that
    count NaN as missing use :func:`rule_column` or :func:`if_else_columns`."""
    return F.when(_condition(cond), _outcome(then)).otherwise(_outcome(other))


def round_columns(df: DataFrame, col: Sequence[str] | str | None = None, precision: int = 2) -> DataFrame:
    """Round the column(s), or every numeric column, half to even."""
    cols = as_list(col) or numeric_columns(df)
    check_columns(df, cols)
    return df.withColumns({c: F.bround(quoted(c), precision).cast(type_of(df, c)) for c in cols})


def number_to_string(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """Numbers as text; missing stays missing."""
    return df.withColumns({c: value(df, c).cast("string") for c in as_list(cols)})


def parse_double(text: Column) -> Column:
    """Text as a double, missing if it is no number.

    The plain cast also takes type suffixes (``1d``) and hexadecimal notation, which
    are no numbers here.
    """
    java_only = text.rlike(r"(?i)[0-9.]\s*[df]\s*$|0x")
    number = F.when(~java_only, text.try_cast("double"))
    return F.nanvl(number, F.lit(None).cast("double"))


def parse_bigint(text: Column) -> Column:
    return text.try_cast("bigint")


def string_to_number(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """Text as doubles, missing if unparsable."""
    return df.withColumns({c: parse_double(quoted(c).cast("string")) for c in as_list(cols)})


def double_to_int(df: DataFrame, cols: Sequence[str] | str, strict: bool = False) -> DataFrame:
    """Whole part of doubles; ``strict`` fails on a fraction instead."""

    def whole(c: str) -> Column:
        number = value(df, c)
        cut = number.cast("bigint")
        if not strict:
            return cut
        bad = number != cut
        message = F.concat(F.lit(f"{c} has a fraction: "), number.cast("string"))
        return F.when(bad, F.raise_error(message).cast("bigint")).otherwise(cut)

    return df.withColumns({c: whole(c) for c in as_list(cols)})


def concat_text(*parts) -> Column:
    """Texts and values in a row: plain Python text is literal, columns are cast."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def assign_column(df: DataFrame, name: str, outcome) -> DataFrame:
    """Unconditional assignment of a literal or a column."""
    return df.withColumn(name, _outcome(outcome))


def system_columns(
    df: DataFrame,
    user: str | None = None,
    row_count: str | None = None,
    row_index: str | None = None,
    order_by: Sequence[str] | str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add the user name, the number of rows and the 0-based row index, each under the given name."""
    if row_count:
        total = df.agg(F.count("*")).scalar()
    if row_index:
        if not order_by:
            raise ValueError("a row index needs order_by")
        df = counter(df, order_by, row_index, start=0, unique=unique)
    extra = {}
    if user:
        extra[user] = F.current_user()
    if row_count:
        extra[row_count] = total
    return df.withColumns(extra) if extra else df
