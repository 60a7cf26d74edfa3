"""Parameterised SQL over registered tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def mark_params(sql: str) -> str:
    """Write ``$${NAME}$$`` variables as named markers ``:NAME``."""
    return re.sub(r"\$\$\{(\w+)\}\$\$", r":\1", sql)


def read_sql(
    spark: SparkSession, sql: str, params: Mapping | None = None, tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Table of a SQL text; ``params`` fill its named markers as values, never as text.

    ``tables`` are registered as temporary views first.
    """
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(mark_params(sql), args=dict(params or {}))


class NamedQueries:
    """A catalog of SQL texts, each run by name."""

    def __init__(self, spark: SparkSession, catalog: Mapping[str, str]):
        self._spark = spark
        self._catalog = dict(catalog)

    def names(self) -> list[str]:
        return list(self._catalog)

    def run(self, name: str, params: Mapping | None = None) -> DataFrame:
        if name not in self._catalog:
            raise KeyError(f"no query {name!r}; there are {self.names()}")
        return read_sql(self._spark, self._catalog[name], params)

    def function(self, name: str) -> Callable[..., DataFrame]:
        return lambda **params: self.run(name, params)

    def register_views(self) -> None:
        """Make every query without parameters readable as a view of its name."""
        for name, sql in self._catalog.items():
            if ":" not in re.sub(r"'[^']*'|::", "", mark_params(sql)):
                self.run(name).createOrReplaceTempView(name)


def named_queries(spark: SparkSession, catalog: Mapping[str, str]) -> NamedQueries:
    return NamedQueries(spark, catalog)
