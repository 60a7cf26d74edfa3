"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a table of SHA-256 digests, bucketed and sorted by digest.  New data is reduced
to one row per digest (partial aggregates run before the shuffle, so a digest that a third
of the rows share costs one row per task), anti-joined with the index by sort-merge, and
what is new is appended.  Only digests and ids are shuffled; texts are read once for
hashing and never moved by :func:`find_copies`.

Defined results: a null text equals the empty text.  Of equal texts the largest id stays; a
text that is in the index from an earlier batch stays with the id kept there.  A null id is
smaller than any other; a group of null ids only keeps a null.  Repeated rows (same id and
text) count one each in ``group_size``; all are marked kept, and :func:`drop_copies` leaves
one.  An empty table gives an empty result.  Other columns, whatever their names, are
neither read nor changed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..missing import quoted
from ..session import materialize, new_path
from .common import corpus_table, free_name


def text_digest(text: Column) -> Column:
    """SHA-256 of the text as 32 bytes; null as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


@dataclass(frozen=True)
class DigestIndex:
    """Table ``(digest binary, keep_id bigint)`` at ``path``, bucketed and sorted by digest.

    ``path`` must be a folder that all executors reach.  Another session opens the same
    index by giving the same path and number of buckets; size ``buckets`` so that one
    bucket of the final index fits a task (48 bytes a digest).
    """

    spark: SparkSession
    path: str
    buckets: int = 32
    name: str = ""

    def __post_init__(self):
        if not self.name:
            object.__setattr__(self, "name", f"digest_index_{uuid.uuid4().hex}")
        place = self.path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(self.buckets)} BUCKETS LOCATION '{place}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add rows whose digests the index lacks, a sorted file for each bucket."""
        one_file_each = rows.select("digest", "keep_id").repartition(self.buckets, "digest")
        one_file_each.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def find_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``digest``, ``keep_id``, ``group_size``, ``kept``.

    Appends the new digests to ``index``.  Running a batch again after a failure gives the
    same rows, because ids already in the index are those the batch would keep.
    """
    digests = materialize(
        docs.select(
            quoted(id_col).cast("bigint").alias("id"), text_digest(quoted(text_col)).alias("digest")
        ),
        "digests",
    )
    groups = digests.groupBy("digest").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("group_size"))
    fresh = groups.join(index.read().hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", F.col("largest").alias("keep_id")))
    decided = materialize(
        groups.join(index.read().hint("merge"), "digest").select("digest", "keep_id", "group_size"), "decided"
    )
    # Both sides come from storage, so adaptive execution can split the rows of a hot digest.
    return digests.join(decided, "digest").select(
        F.col("id").alias(id_col),
        "digest",
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    found = find_copies(docs, index, id_col, text_col).where("kept")
    mark, absent, known = (free_name(docs, x) for x in ("digest", "id_absent", "id_known"))
    keys = [mark, absent, known]  # none is ever null, so the join and the last step share one shuffle
    stay = found.select(
        F.col("digest").alias(mark),
        quoted(id_col).isNull().alias(absent),
        F.coalesce(quoted(id_col), F.lit(0)).alias(known),
    )
    whole = docs.withColumns(
        {
            mark: text_digest(quoted(text_col)),
            absent: quoted(id_col).isNull(),
            known: F.coalesce(quoted(id_col).cast("bigint"), F.lit(0)),
        }
    )
    return whole.join(stay.distinct().hint("merge"), keys, "left_semi").dropDuplicates(keys).select(
        *[quoted(c) for c in docs.columns]
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus_table(spark, sf_dir, "documents")
    found = find_copies(docs, DigestIndex(spark, new_path(spark, "digest-index")))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE = {"op4_exact_dedup": OP4_SQL}
