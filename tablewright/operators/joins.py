"""Equi joins whose missing keys match each other.

Left, right and outer joins are composed of the inner join and the unmatched rows of
a side.  Adaptive execution splits a hot key on either side of an inner join and on
the left of an anti join, but never on the null-supplying side of an outer join; the
unmatched part only needs the distinct keys of the other side, so no hot key is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..missing import as_list, check_columns, quoted, same_keys, without_nan

JOIN_KINDS = {
    "inner": (True, False, False),
    "left": (True, True, False),
    "right": (True, False, True),
    "outer": (True, True, True),
}


def _key_pairs(left: DataFrame, right: DataFrame, left_on, right_on) -> list[tuple[str, str]]:
    left_on, right_on = as_list(left_on), as_list(right_on)
    if not left_on and not right_on:
        left_on = [c for c in left.columns if c in right.columns]
        if not left_on:
            raise ValueError("the tables share no column name to join on")
    right_on = right_on or left_on
    if len(left_on) != len(right_on):
        raise ValueError("give as many left keys as right keys")
    check_columns(left, left_on)
    check_columns(right, right_on)
    return list(zip(left_on, right_on))


def _side(name: str, column: str) -> Column:
    return F.col(f"{name}.`" + column.replace("`", "``") + "`")


def _zero(kind: T.DataType) -> Column | None:
    """A value to stand for a missing key of that type, next to a flag; none for rarer types."""
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit("") if isinstance(kind, T.StringType) else None


def _unmatched(side: DataFrame, other: DataFrame, pairs, null_safe: bool) -> DataFrame:
    """Rows of ``side`` without a partner.

    Missing keys are compared as (value or zero, is missing), the pairs by which a null-safe
    join is shuffled: the distinct keys then lie where the join wants them, and ``side`` lies as
    in the inner join, whose shuffle is used again.
    """
    keys, cond = [], None
    for i, (s, o) in enumerate(pairs):
        zero = _zero(side.schema[s].dataType) if side.schema[s].dataType == other.schema[o].dataType else None
        if null_safe and zero is not None:
            keys += [F.coalesce(quoted(o), zero).alias(f"__k{i}"), quoted(o).isNull().alias(f"__n{i}")]
            one = (F.coalesce(quoted(s), zero) == F.col(f"__k{i}")) & (quoted(s).isNull() == F.col(f"__n{i}"))
        else:
            keys.append(quoted(o).alias(f"__k{i}"))
            one = same_keys([(s, f"__k{i}")], null_safe)
        cond = one if cond is None else cond & one
    return side.join(other.select(*keys).distinct(), cond, "left_anti")


def join_by_flags(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str] | str | None = None,
    right_on: Sequence[str] | str | None = None,
    matches: bool = True,
    left_unmatched: bool = False,
    right_unmatched: bool = False,
    null_safe: bool = True,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Equi join whose output holds any of: matches, left rest, right rest.

    Without keys, all common column names are the keys.  A key pair of one name
    appears once; pairs of different names keep both columns.  Other common names
    get the suffixes.  ``null_safe=False`` lets missing keys match nothing; by default
    they match each other, so many missing keys on both sides give their product.
    """
    pairs = _key_pairs(left, right, left_on, right_on)
    shared = {l for l, r in pairs if l == r}
    clash = (set(left.columns) & set(right.columns)) - shared

    left = without_nan(left, [l for l, _ in pairs])
    right = without_nan(right, [r for _, r in pairs])
    out = [(c + suffixes[0] if c in clash else c, c, None) for c in left.columns]
    out += [(c + suffixes[1] if c in clash else c, None, c) for c in right.columns if c not in shared]
    names = [n for n, _, _ in out]
    if len(set(names)) != len(names):
        raise ValueError(f"the suffixes {suffixes} leave repeated names in {names}")

    def both(how: str) -> DataFrame:
        cond = None
        for l, r in pairs:
            a, b = _side("__l", l), _side("__r", r)
            one = a.eqNullSafe(b) if null_safe else a == b
            cond = one if cond is None else cond & one
        cols = []
        for name, l, r in out:
            col = _side("__l", l) if l else _side("__r", r)
            if l in shared and how == "right":
                col = _side("__r", l)
            cols.append(col.alias(name))
        return left.alias("__l").join(right.alias("__r"), cond, how).select(*cols)

    def only(side: DataFrame, other: DataFrame, at: int, keys) -> DataFrame:
        cols = []
        for name, *source in out:
            c = source[at] or (source[0] if source[0] in shared else None)
            absent = other.schema[source[1 - at]].dataType if c is None else None
            cols.append((F.lit(None).cast(absent) if c is None else quoted(c)).alias(name))
        return _unmatched(side, other, keys, null_safe).select(*cols)

    parts = []
    if matches:
        parts.append(both("inner"))
    if left_unmatched:
        parts.append(only(left, right, 0, pairs))
    if right_unmatched:
        parts.append(only(right, left, 1, [(r, l) for l, r in pairs]))
    if not parts:
        return both("inner").limit(0)
    return reduce(DataFrame.unionByName, parts)


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str] | str | None = None,
    right_on: Sequence[str] | str | None = None,
    how: str = "inner",
    null_safe: bool = True,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Inner, left, right or outer equi join; see :func:`join_by_flags`."""
    if how not in JOIN_KINDS:
        raise ValueError(f"how is one of {list(JOIN_KINDS)}, not {how!r}")
    return join_by_flags(left, right, left_on, right_on, *JOIN_KINDS[how], null_safe, suffixes)
