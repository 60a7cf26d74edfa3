"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(float(f"{value:.12g}") + 0.0)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def kind(name: str) -> str:
    name = name.lower()
    for short, words in {
        "int": ("int", "hugeint"),
        "float": ("double", "float", "decimal"),
        "text": ("varchar", "string"),
        "time": ("timestamp",),
        "bool": ("bool",),
    }.items():
        if any(w in name for w in words):
            return short
    return name


def difference(df, con, sql: str) -> str | None:
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_names, want = table(rel.columns, rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    kinds = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    for name, dtype in zip(rel.columns, rel.types):
        if kinds[name] != kind(str(dtype)):
            return f"type of {name}: {kinds[name]} != {dtype}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"row {str(a)[:500]} != {str(b)[:500]}"
    return None


if __name__ == "__main__":
    from tests.conftest import new_session
    from tablewright.plans import ORACLE, QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = new_session(), duck(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            result = difference(df, con, ORACLE[name]) if name in ORACLE else f"rows only: {df.count()}"
        except Exception as error:  # reported per query
            result = f"{type(error).__name__}: {str(error)[:700]}"
        if result and not result.startswith("rows only"):
            bad += 1
        print(f"{time.time() - start:6.2f} {name}: {result or 'ok'}", flush=True)
    print(f"{bad} of {len(names)} differ")
