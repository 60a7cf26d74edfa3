"""User Python over tables, in Arrow batches.

No function here ever receives a whole group: a group is folded slice by slice into
small states, which are merged per task and then per key.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..missing import as_list, check_columns, quoted, value
from .joins import join_tables
from .rows import sort_rows

Frame = pd.DataFrame


def _schema(schema) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    return T.StructType.fromDDL(schema)


def python_table(
    df: DataFrame, fn: Callable[[Frame], Frame], schema: T.StructType | str, cols: Sequence[str] | None = None
) -> DataFrame:
    """Apply ``fn`` to the table batch by batch; each batch holds whole rows.

    ``cols`` names the columns ``fn`` reads, so that only these reach Python.
    """
    if cols:
        check_columns(df, cols)
        df = df.select(*[quoted(c) for c in cols])

    def run(batches: Iterator[Frame]) -> Iterator[Frame]:
        return map(fn, batches)

    return df.mapInPandas(run, _schema(schema))


def python_two_tables(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] | str,
    fn: Callable[[Frame], Frame],
    schema: T.StructType | str,
    how: str = "inner",
) -> DataFrame:
    """Apply ``fn`` to the rows of two tables matched on ``keys``, batch by batch.

    Spark matches the rows, so a key of any size is spread over tasks; other common
    column names carry the suffixes ``_x`` and ``_y``.
    """
    return python_table(join_tables(a, b, keys, how=how), fn, schema)


def row_function(
    df: DataFrame, out: str, fn: Callable[..., pd.Series], type: str | T.DataType, cols: Sequence[str] | str
) -> DataFrame:
    """Add a column computed by vectorised user code over the listed columns."""
    check_columns(df, as_list(cols))
    return df.withColumn(out, F.pandas_udf(fn, returnType=type)(*[quoted(c) for c in as_list(cols)]))


def for_each_group(
    df: DataFrame,
    keys: Sequence[str] | str,
    fold: Callable[[Frame], dict],
    merge: Callable[[Frame], dict],
    state: str,
    finish: dict[str, Column | str] | None = None,
    slice_rows: int = 100_000,
    frames: bool = False,
) -> DataFrame:
    """Run user code for every group, whatever its size.

    ``fold`` turns a slice of one group's rows into a state (a dict shaped like the DDL
    ``state``); ``merge`` turns a frame of such states of one group into one state, and
    must give the same result for any split into slices.  ``finish`` maps output
    columns to expressions over the state; without it the state is the output.  Rows with
    a missing key belong to no group.

    The rows are sorted by key into ranges first, a large group over several, so there is a call
    per group, range and ``slice_rows`` rows, however the rows of the groups were mixed.  With
    ``frames`` the rows are not moved: ``fold`` and ``merge`` take frames of many groups and
    return a frame of the keys and states, one row per group.  That is for code pandas
    groups by itself, and for few large groups.

    A task folds ``slice_rows`` rows at a time and merges its own states; states are shuffled,
    and the last merge streams over them sorted by key.
    """
    keys = as_list(keys)
    check_columns(df, keys)
    fields = T.StructType.fromDDL(state)
    clean = df.select(*[value(df, c).alias(c) if c in keys else quoted(c) for c in df.columns])
    for k in keys:
        clean = clean.filter(quoted(k).isNotNull())
    schema = T.StructType([*[clean.schema[k] for k in keys], *fields.fields])
    columns = schema.names

    def run(frame: Frame, step: Callable[[Frame], dict | Frame]) -> Frame:
        """One state per group of the frame."""
        if frames:
            return step(frame)[columns]
        made = []
        for key, rows in frame.groupby(keys, sort=False):
            key = key if isinstance(key, tuple) else (key,)
            made.append({**dict(zip(keys, key)), **step(rows)})
        return pd.DataFrame(made, columns=columns)

    def combine(states: Frame) -> Frame:
        """One state per group; groups that have a single state are left alone."""
        repeated = states.duplicated(keys, keep=False)
        if not repeated.any():
            return states
        return pd.concat([states[~repeated], run(states[repeated], merge)], ignore_index=True)

    def fold_task(batches: Iterator[Frame]) -> Iterator[Frame]:
        rows, n, states = [], 0, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rows.append(batch)
                n += len(batch)
                if n < slice_rows:
                    continue
            if n:
                made = run(pd.concat(rows, ignore_index=True), fold)
                rows, n = [], 0
                states = made if states is None else combine(pd.concat([states, made], ignore_index=True))
                if len(states) >= slice_rows:
                    yield states
                    states = None
        if states is not None:
            yield states

    def merge_sorted(batches: Iterator[Frame]) -> Iterator[Frame]:
        open_group = None
        for batch in batches:
            if batch.empty:
                continue
            last = batch[keys].iloc[-1]
            frame = batch if open_group is None else pd.concat([open_group, batch], ignore_index=True)
            states = combine(frame)
            is_open = (states[keys] == last).all(axis=1)
            open_group = states[is_open]
            yield states[~is_open]
        if open_group is not None:
            yield open_group

    group = [quoted(k) for k in keys]
    rows = clean if frames else sort_rows(clean, keys, copies=True)
    states = rows.mapInPandas(fold_task, schema)
    merged = states.repartition(*group).sortWithinPartitions(*group).mapInPandas(merge_sorted, schema)
    if finish is None:
        return merged
    return merged.select(
        *group, *[(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in finish.items()]
    )
