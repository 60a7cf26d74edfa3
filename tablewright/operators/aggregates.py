"""Grouped and whole-table aggregation.

Every method keeps a bounded state per group: exact medians are read off by rank,
modes and distinct counts are taken from pre-counted (group, value) pairs, and long
lists come in numbered pieces.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..missing import as_list, check_columns, numeric_columns, quoted, same_keys, value
from .ranking import BEFORE, weights_before
from .selection import medians
from .sketches import approx_distinct

# Display names of the aggregation methods.
METHOD_NAMES = {
    "sum": "sum",
    "mean": "mean",
    "count": "count",
    "min": "min",
    "max": "max",
    "median": "median",
    "standard deviation": "std",
    "variance": "var",
    "first": "first",
    "last": "last",
    "list": "list",
    "unique count": "nunique",
    "mode": "mode",
}

SIMPLE = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.countDistinct,
}


def method_name(method: str) -> str:
    """Short name of a method given by display or short name, version suffix ignored."""
    plain = re.sub(r"_V[\d.]+$", "", method).lower()
    short = METHOD_NAMES.get(plain, plain)
    if short not in METHOD_NAMES.values():
        raise ValueError(f"unknown aggregation method {method!r}; choose from {sorted(METHOD_NAMES)}")
    return short


def _edge(df: DataFrame, col: str, method: str, order_by) -> Column:
    """First or last non-missing value, by order columns where they are given."""
    seen = value(df, col)
    if not order_by:
        return (F.first if method == "first" else F.last)(seen, ignorenulls=True)
    order = [quoted(o) for o in as_list(order_by)]
    # One plain order column keeps the state fixed-width, which is hashed rather than sorted.
    place = F.when(seen.isNotNull(), order[0] if len(order) == 1 else F.struct(*order))
    return (F.min_by if method == "first" else F.max_by)(seen, place)


def _value_counts(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """How often each non-missing value of ``col`` occurs per group."""
    seen = df.select(*[quoted(k) for k in keys], value(df, col).alias("__value"))
    return seen.where("__value IS NOT NULL").groupBy(*[quoted(k) for k in keys], "__value").agg(
        F.count("*").alias("__n")
    )


def _mode(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    best = F.min_by("__value", F.struct(-F.col("__n"), F.col("__value")))
    return _value_counts(df, keys, col).groupBy(*[quoted(k) for k in keys]).agg(best.alias(col))


def _median(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    return medians(df, keys, value(df, col), col)


SEPARATE = {"median": _median, "mode": _mode}


def group_by(
    df: DataFrame,
    keys: Sequence[str] | str,
    aggs: Mapping[str, str] | None = None,
    order_by: Sequence[str] | str | None = None,
    keep_null_keys: bool = False,
    approx: bool = False,
) -> DataFrame:
    """One row per group; each aggregated column keeps its name.

    ``aggs`` maps a column to a method.  Without it, every other column gives its first
    non-missing value.  Groups with a missing key are dropped unless ``keep_null_keys``.
    ``first``/``last`` are deterministic only with ``order_by``.  No keys and no
    ``aggs`` return the table unchanged; no keys aggregate the whole table.  ``approx`` estimates
    distinct counts from sketches (see ``sketches``), whose error :func:`distinct_bound` states.
    """
    keys = as_list(keys)
    check_columns(df, keys)
    if aggs is None:
        if not keys:
            return df
        aggs = {c: "first" for c in df.columns if c not in keys}
    methods = {c: method_name(m) for c, m in aggs.items()}
    check_columns(df, methods)
    if "list" in methods.values():
        raise ValueError("a list per group has no size bound: use list_pieces")

    used = [c for c in df.columns if c in {*keys, *methods, *as_list(order_by)}]
    df = df.select(
        *[value(df, c).alias(c) if c in keys else quoted(c) for c in used]
    )
    if not keep_null_keys:
        for k in keys:
            df = df.filter(quoted(k).isNotNull())

    built_in = {}
    for c, m in methods.items():
        if m == "nunique" and approx:
            built_in[c] = approx_distinct(df, c)
        elif m in SIMPLE:
            built_in[c] = SIMPLE[m](value(df, c))
        elif m in ("first", "last"):
            built_in[c] = _edge(df, c, m, order_by)
    group = [quoted(k) for k in keys]
    exprs = [e.alias(c) for c, e in built_in.items()]
    if exprs:
        out = df.groupBy(*group).agg(*exprs)
    else:
        out = df.select(*group).distinct() if keys else df.groupBy().agg(F.count("*").alias("__rows"))
    for c, m in methods.items():
        if m not in SEPARATE:
            continue
        part = SEPARATE[m](df, keys, c)
        if not keys:
            out = out.withColumn(c, part.scalar())
            continue
        names = [f"__k{i}" for i in range(len(keys))]
        out = out.join(part.toDF(*names, c), same_keys(list(zip(keys, names))), "left").drop(*names)
    return out.select(*group, *[quoted(c) for c in methods])


def list_pieces(
    df: DataFrame,
    keys: Sequence[str] | str,
    col: str,
    order_by: Sequence[str] | str,
    piece_rows: int = 10_000,
) -> DataFrame:
    """All values per group in order, missing ones too, as numbered arrays.

    Columns: the keys, ``piece`` (from 0) and ``col`` as an array of at most
    ``piece_rows`` values; the pieces of a group in order are its whole list.
    ``order_by`` must identify the rows of a group.
    """
    keys, order_by = as_list(keys), as_list(order_by)
    check_columns(df, [*keys, col, *order_by])
    rows = df.select(
        *[value(df, k).alias(k) for k in keys],
        value(df, col).alias("__value"),
        *[quoted(o).alias(f"__o{i}") for i, o in enumerate(order_by)],
        F.lit(1).alias("__one"),
    )
    for k in keys:
        rows = rows.filter(quoted(k).isNotNull())
    placed = weights_before(rows, keys, [f"__o{i}" for i in range(len(order_by))], "__one", null_keys=False)
    piece = F.expr(f"{BEFORE} div {int(piece_rows)}")
    cells = F.array_sort(F.collect_list(F.struct(BEFORE, "__value")))
    return (
        placed.groupBy(*[quoted(k) for k in keys], piece.alias("piece"))
        .agg(F.transform(cells, lambda cell: cell["__value"]).alias(col))
    )


def aggregate_columns(df: DataFrame, method: str = "sum", cols: Sequence[str] | None = None) -> DataFrame:
    """One row: the method applied to each numeric (or listed) column."""
    names = list(cols) if cols else numeric_columns(df)
    return group_by(df, [], {c: method for c in names})
