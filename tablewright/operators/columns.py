"""Column selection, renaming, ordering and constants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..missing import check_columns, quoted

# Accepted type names of a constant column.
CONSTANT_TYPES = {
    "string": "string",
    "int": "bigint",
    "long": "bigint",
    "double": "double",
}


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the listed columns, in list order."""
    check_columns(df, cols)
    return df.select(*[quoted(c) for c in cols])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename old to new names; unknown old names are ignored."""
    renamed = [mapping.get(c, c) for c in df.columns]
    if len(set(renamed)) != len(renamed):
        raise ValueError(f"the new names are not unique: {renamed}")
    return df.withColumnsRenamed(dict(mapping))


def reorder_columns(df: DataFrame, cols: Sequence[str], keep_rest: bool = False) -> DataFrame:
    """Put the listed columns first; the others are dropped unless ``keep_rest``."""
    check_columns(df, cols)
    rest = [c for c in df.columns if c not in cols] if keep_rest else []
    return df.select(*[quoted(c) for c in [*cols, *rest]])


def constant_column(df: DataFrame, name: str = "new_column", value="", type: str = "string") -> DataFrame:
    """Add or replace a column holding one literal."""
    if type not in CONSTANT_TYPES:
        raise ValueError(f"type is one of {list(CONSTANT_TYPES)}, not {type!r}")
    return df.withColumn(name, F.lit(value).cast(CONSTANT_TYPES[type]))
