"""Exact medians by narrowing brackets.

A group of many values is never sorted.  A histogram of BINS equal steps shows between which values the middle
ranks lie.  Where such a bracket still holds many values, as the values are unevenly spread, a summary
of bounded size (quantiles with a guaranteed rank error) narrows it: one pass counts what lies below, inside and on
two of its values; and so on until the bracket holds a few values.  What is left is counted per value and ranked in
the group.  Only summaries and counters are shuffled, after they were combined in each task, so a hot
group is as cheap as any other.  Groups that are small from the start go to the last step at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..missing import quoted, same_keys
from ..session import materialize

BINS = 1024  # steps of the histogram
FEW = 10_000  # values of a group that are ranked without a bracket
ACCURACY = 2000  # the rank error of a summary is a share of 1 / ACCURACY
GRID = [i / 64 for i in range(65)]  # quantiles asked for inside a bracket
PASSES = 12  # a pass leaves a twentieth of a bracket; what may be left after so many is ranked as it is


def _named(keys: Sequence[str]) -> list[Column]:
    return [quoted(k) for k in keys]


def _with_bracket(values: DataFrame, keys: Sequence[str], brackets: DataFrame) -> DataFrame:
    """Values inside the bracket of their group, bounds included, with the columns of the bracket."""
    inside = F.col("__value").between(F.col("__lo"), F.col("__hi"))
    if not keys:
        one = brackets.select(F.struct("*")).scalar()
        return values.withColumns({c: one[c] for c in brackets.columns}).where(inside)
    names = [f"__b{i}" for i in range(len(keys))]
    renamed = brackets.withColumnsRenamed(dict(zip(keys, names)))
    return values.join(renamed, same_keys(list(zip(keys, names))) & inside).drop(*names)


def _histogram(values: DataFrame, keys: Sequence[str], brackets: DataFrame) -> DataFrame:
    """The brackets after a histogram between the smallest and the largest value of each group."""
    state = ["__low", "__high"]
    inside = _with_bracket(values, keys, brackets.select(*_named(keys), *state, "__lo", "__hi"))
    value, lo, hi = F.col("__value"), F.col("__lo"), F.col("__hi")
    step = F.floor((value - lo) / (hi - lo) * BINS)
    endless = (hi - lo) == float("inf")  # the ends apart from what is between them
    even = F.when(value == lo, 0).when(value == hi, BINS - 1).otherwise(BINS // 2)
    place = F.when(hi == lo, 0).when(endless, even).otherwise(F.least(step, F.lit(BINS - 1)))
    bins = inside.groupBy(*_named(keys), *state, place.cast("int").alias("__bin")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__value").alias("__lo"), F.max("__value").alias("__hi")
    )
    order = Window.partitionBy(*_named(keys)).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows
    placed = bins.withColumn("__upto", F.sum("__n").over(order))
    holds = lambda rank: (F.col("__upto") - F.col("__n") <= F.col(rank)) & (F.col(rank) < F.col("__upto"))
    middle = placed.where(holds("__low") | holds("__high")).groupBy(*_named(keys), *state)
    return middle.agg(
        F.min("__lo").alias("__lo"),
        F.max("__hi").alias("__hi"),
        F.min(F.col("__upto") - F.col("__n")).alias("__below"),
        F.when(F.min("__lo") < F.max("__hi"), F.sum("__n")).otherwise(0).alias("__inside"),  # one value is done
    )


def _grid_bounds(fractions: Sequence[float]) -> tuple[Column, Column]:
    """The asked quantiles next below the lower and next above the upper middle rank, with room for
    the rank error; the old bounds where none is asked for."""
    error = 2 / ACCURACY
    low = (F.col("__low") - F.col("__below")) / F.col("__n") - error
    high = (F.col("__high") + 1 - F.col("__below")) / F.col("__n") + error
    lo, hi = F.col("__lo"), F.col("__hi")
    for i, fraction in enumerate(fractions):
        lo = F.when(low >= fraction, F.get("__quantiles", F.lit(i))).otherwise(lo)
    for i, fraction in reversed(list(enumerate(fractions))):
        hi = F.when(high <= fraction, F.get("__quantiles", F.lit(i))).otherwise(hi)
    return lo, hi


def _narrowed(values: DataFrame, keys: Sequence[str], brackets: DataFrame) -> DataFrame:
    """The brackets after one pass: the values are summarised, then counted against the new bounds."""
    state = ["__low", "__high", "__below", "__lo", "__hi"]
    asked = F.array(*[F.lit(x) for x in GRID])
    seen = _with_bracket(values, keys, brackets.select(*_named(keys), *state)).groupBy(*_named(keys), *state)
    seen = seen.agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__value", asked, ACCURACY).alias("__quantiles"))
    lo, hi = _grid_bounds(GRID)
    bounds = seen.select(*_named(keys), *state, lo.alias("__new_lo"), hi.alias("__new_hi"))

    value, new_lo, new_hi = F.col("__value"), F.col("__new_lo"), F.col("__new_hi")
    counted = _with_bracket(values, keys, bounds).groupBy(*_named(keys), *state, "__new_lo", "__new_hi").agg(
        F.count_if(value < new_lo).alias("__less"),
        F.count_if(value <= new_hi).alias("__upto"),
        F.count_if((value > new_lo) & (value < new_hi)).alias("__between"),
        F.count(F.lit(1)).alias("__all"),
    )
    below = F.col("__below") + F.col("__less")
    holds = (F.col("__low") >= below) & (F.col("__high") < F.col("__below") + F.col("__upto"))
    return counted.select(
        *_named(keys),
        "__low",
        "__high",
        F.when(holds, new_lo).otherwise(F.col("__lo")).alias("__lo"),
        F.when(holds, new_hi).otherwise(F.col("__hi")).alias("__hi"),
        F.when(holds, below).otherwise(F.col("__below")).alias("__below"),
        F.when(holds, F.col("__between")).otherwise(F.col("__all")).alias("__inside"),
    )


def medians(df: DataFrame, keys: Sequence[str], col: Column, name: str) -> DataFrame:
    """``keys, name``: the exact median of a numeric column per group, null where a group has no value.

    Missing keys are a group of their own.  Writes the brackets of large groups as intermediate tables.
    """
    keys = list(keys)
    values = df.select(*_named(keys), col.cast("double").alias("__value")).where("__value IS NOT NULL")
    sizes = values.groupBy(*_named(keys)).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__value").alias("__lo"), F.max("__value").alias("__hi")
    ).where(F.col("__n") > FEW)
    low, high = F.expr("(__n - 1) div 2"), F.expr("__n div 2")  # 0-based; one rank for an odd size
    brackets = materialize(
        sizes.select(
            *_named(keys),
            low.alias("__low"),
            high.alias("__high"),
            "__lo",
            "__hi",
        ),
        "brackets",
    )
    state = ["__below", "__low", "__high"]
    none = [F.lit(0).cast("bigint").alias("__below"), *[F.lit(None).cast("bigint").alias(c) for c in state[1:]]]
    if brackets.isEmpty():
        left = values.select(*_named(keys), "__value", *none)
    else:
        now = materialize(_histogram(values, keys, brackets), "brackets")
        for _ in range(PASSES):
            open_ = now.where(F.col("__inside") > FEW)
            if open_.isEmpty():
                break
            now = materialize(now.where(F.col("__inside") <= FEW).unionByName(_narrowed(values, keys, open_)), "brackets")
        left = _with_bracket(values, keys, now.select(*_named(keys), "__lo", "__hi", *state))
        left = left.select(*_named(keys), "__value", *state)
        if keys:
            names = [f"__b{i}" for i in range(len(keys))]
            large = brackets.select(*[quoted(k).alias(n) for k, n in zip(keys, names)])
            small = values.join(large, same_keys(list(zip(keys, names))), "left_anti")
            left = left.unionByName(small.select(*_named(keys), "__value", *none))
    counts = left.groupBy(*_named(keys), "__value", "__below", "__low", "__high").agg(F.count(F.lit(1)).alias("__n"))
    # A group holds the values of its bracket, FEW and the two bounds.
    group = Window.partitionBy(*_named(keys))
    upto = F.col("__below") + F.sum("__n").over(group.orderBy("__value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"__upto": upto, "__size": F.sum("__n").over(group)}).withColumns(
        {
            "__low": F.coalesce("__low", F.expr("(__size - 1) div 2")),
            "__high": F.coalesce("__high", F.expr("__size div 2")),
        }
    )
    covers = lambda rank: (F.col("__upto") - F.col("__n") <= F.col(rank)) & (F.col(rank) < F.col("__upto"))
    middle = ranked.where(covers("__low") | covers("__high")).groupBy(*_named(keys))
    return middle.agg(((F.min("__value") + F.max("__value")) / 2).alias(name))
