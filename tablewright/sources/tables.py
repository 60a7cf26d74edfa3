"""Tables in files, warehouses and databases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

def jdbc_options(
    url: str,
    query: str | None = None,
    table: str | None = None,
    partition: Mapping | None = None,
    fetchsize: int = 10_000,
    **props,
) -> dict[str, str]:
    """Options of a JDBC read.

    ``partition`` is ``{"column", "lower", "upper", "n"}``: n parallel range queries.
    Spark splits a table or a derived table only, so a partitioned query becomes one.
    """
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    options = {"url": url, "fetchsize": fetchsize, **props}
    if partition:
        options["dbtable"] = table or f"({query}) part_source"
        options.update(
            partitionColumn=partition["column"],
            lowerBound=partition["lower"],
            upperBound=partition["upper"],
            numPartitions=partition["n"],
        )
    elif query:
        options["query"] = query
    else:
        options["dbtable"] = table
    return {k: str(v) for k, v in options.items()}


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str | None = None,
    table: str | None = None,
    partition: Mapping | None = None,
    **props,
) -> DataFrame:
    """Table or query result of a database; see :func:`jdbc_options`."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, table, partition, **props)).load()


def read_table(spark: SparkSession, fmt: str, path: str | None = None, schema=None, **opts) -> DataFrame:
    """Table of any installed source format; credentials are options of the format."""
    reader = spark.read.format(fmt).options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def write_table(df: DataFrame, target: str, fmt: str = "parquet", mode: str = "append", **opts) -> None:
    """Append a table: ``target`` is a catalog table (``fmt="table"``), a database table
    (``fmt="jdbc"``) or a path."""
    writer = df.write.mode(mode).options(**opts)
    if fmt == "table":
        writer.saveAsTable(target)
    elif fmt == "jdbc":
        writer.format("jdbc").option("dbtable", target).save()
    else:
        writer.format(fmt).save(target)
