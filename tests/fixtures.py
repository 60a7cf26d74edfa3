"""Small hand-made tables with gaps, NaN, ties, copies and a hot key."""

from __future__ import annotations

import datetime as dt
import random

EDGE_SCHEMA = "k string, g string, n bigint, x double, t string, d timestamp_ntz"

EDGE_ROWS = [
    ("a", "g1", 1, 2.5, "12", dt.datetime(2024, 1, 2)),
    ("b", "g1", 2, 3.5, " 1e3 ", dt.datetime(2024, 1, 3, 23)),
    ("b", "g1", 2, 3.5, " 1e3 ", dt.datetime(2024, 1, 3, 23)),
    (None, "g2", None, float("nan"), "x", None),
    ("c", None, 3, -2.7, "", dt.datetime(2024, 2, 29, 12)),
    ("d", "g2", 3, None, None, dt.datetime(2024, 12, 31, 23, 59, 59)),
]


def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


def edge_empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


def right_side(spark):
    return spark.createDataFrame([("a", 10.0), ("b", 20.0), ("b", 21.0), (None, 30.0), ("z", 40.0)], "k string, x double")


def hot_rows(n: int, seed: int = 7):
    """(key, value, id): a third of the rows on one key, some keys and values missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9])
        value = rng.choice([None, float("nan"), *[rng.randrange(20) / 4 for _ in range(6)]])
        rows.append((key, value, i))
    rng.shuffle(rows)
    return rows


def hot(spark, n: int = 3000, seed: int = 7):
    return spark.createDataFrame(hot_rows(n, seed), "key bigint, value double, id bigint").repartition(5)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
