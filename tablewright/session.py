"""Session settings, intermediate tables and size checks shared by the operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Run-time SQL settings the operators count on.  A hot join key is split by
# adaptive execution even where the split costs one more shuffle above the join.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_folders: dict[str, str] = {}  # by application: the folder that the caller gave
_scopes: list[list[str]] = []  # paths written in each open scope, innermost last


def configure(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Apply :data:`SETTINGS` to the session and return it.

    ``folder`` is the place of intermediate tables, one that every executor can reach.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if folder:
        _folders[spark.conf.get("spark.app.id", "")] = folder
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: that given to :func:`configure`, else that in
    ``spark.checkpoint.dir``, else one below the warehouse."""
    given = _folders.get(spark.conf.get("spark.app.id", "")) or spark.conf.get("spark.checkpoint.dir", None)
    return (given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tablewright-{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table.

    Used where a row address (partition, position) becomes data: the stored table
    survives lost executors and is read back with column pruning.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a table written by :func:`materialize`, on whatever file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))


@contextlib.contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Scope of intermediate tables: those written inside are deleted when it is left.

    Finish every action on the frames made inside before leaving.  Scopes nest; tables
    written outside any scope stay until the caller deletes the folder.
    """
    _scopes.append(mine := [])
    try:
        yield
    finally:
        _scopes.remove(mine)
        for path in mine:
            delete_path(spark, path)
