"""Appends that may be run again: each batch of rows is in the table once.

A batch is written to a folder of its own first.  It becomes part of the table when its entry appears in the
manifest, a file named by the batch that is moved there in one step and never replaced.  Readers follow
the manifest, so they see a batch whole or not at all; a writer that is broken off, or that
comes second, leaves a folder that nobody reads and that :func:`remove_unpublished` deletes.
The file system must move a file in one step and refuse to replace one, as HDFS does.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFEST, STAGED, DRAFTS = "manifest", "batches", "drafts"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function from names below it to its paths."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda *names: make("/".join([path, *names]))


def _entry(batch: str) -> str:
    return quote(batch, safe="") or "%"


def is_published(spark: SparkSession, path: str, batch: str) -> bool:
    files, at = _files(spark, path.rstrip("/"))
    return files.exists(at(MANIFEST, _entry(batch)))


def _publish(spark: SparkSession, path: str, batch: str, staged: str) -> bool:
    """Move the entry into the manifest, unless there is one for the batch."""
    jvm = spark.sparkContext._jvm
    files, at = _files(spark, path)
    for folder in (DRAFTS, MANIFEST):
        files.mkdirs(at(folder))
    draft = at(DRAFTS, staged)
    out = files.create(draft, True)
    out.write(staged.encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else jvm.java.net.URI("file:///"))
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: an entry is not replaced
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(at(MANIFEST, _entry(batch))), options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        files.delete(draft, False)
        return False
    return True


def append_batch(df: DataFrame, path: str, batch: str, fmt: str = "parquet", **opts) -> bool:
    """Add the rows as batch ``batch`` to the table at ``path``, a folder that all executors reach.

    Running it again with the same batch changes nothing and returns False, also if two writers
    run at once.  A run that fails adds nothing.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    if is_published(spark, path, batch):
        return False
    staged = uuid.uuid4().hex
    df.write.format(fmt).options(**opts).save(f"{path}/{STAGED}/{staged}")
    if _publish(spark, path, batch, staged):
        return True
    files, at = _files(spark, path)
    files.delete(at(STAGED, staged), True)
    return False


def published(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each batch in the table, one entry per batch."""
    files, at = _files(spark, path.rstrip("/"))
    if not files.exists(at(MANIFEST)):
        return {}
    out = {}
    for status in files.listStatus(at(MANIFEST)):
        entry = files.open(status.getPath())
        folder = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(entry, "UTF-8")
        entry.close()
        out[status.getPath().getName()] = f"{path.rstrip('/')}/{STAGED}/{folder}"
    return out


def read_batches(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **opts) -> DataFrame:
    """The rows of all batches in the table; without any, an empty table of ``schema``."""
    folders = sorted(published(spark, path).values())
    if not folders:
        if schema is None:
            raise ValueError(f"no batch in {path}: give a schema for the empty table")
        return spark.createDataFrame([], schema)
    reader = spark.read.format(fmt).options(**opts)
    return (reader.schema(schema) if schema is not None else reader).load(folders)


def remove_unpublished(spark: SparkSession, path: str, older_than_seconds: float = 86_400) -> int:
    """Delete folders that no batch in the table has and that are that old; returns their number.

    The age must exceed the longest time from the end of a write to its entry in the manifest.
    """
    path = path.rstrip("/")
    files, at = _files(spark, path)
    if not files.exists(at(STAGED)):
        return 0
    known = {folder.rsplit("/", 1)[1] for folder in published(spark, path).values()}
    limit, removed = (time.time() - older_than_seconds) * 1000, 0
    for status in files.listStatus(at(STAGED)):
        if status.getPath().getName() not in known and status.getModificationTime() <= limit:
            removed += bool(files.delete(status.getPath(), True))
    return removed
