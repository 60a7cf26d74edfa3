"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: 64 majority bits over the XXH64 values of a text's word shingles, one pass over
the texts.  Equal fingerprints are collapsed first, so the links are searched between
distinct fingerprints, and a group of copies, however large, is one row.

Two fingerprints at distance 3 or less meet in a variant that has at most 2 flipped bits of
one and at most 1 of the other.  Of all variants within that half of the radius, those are
emitted that some pair needs:

* distance 2: both have the same parity and meet in a variant with one flipped bit of each;
* distance 1: one is a variant of the other with one flipped bit;
* distance 3: exactly one of the two has odd parity, and two of the three differing bits lie
  in the same half of the word.  The odd one flips these two, the even one the third.

So an even fingerprint emits 64 variants, an odd one 1 + 64 + 2 * 496.  In a group of equal
variants each member is at distance 3 or less from any member with at most one flipped bit.
One such hub per group is linked with all others, which connects all the group can prove:
links grow with the members of a group, not with their square, and pairs that meet with
two flipped bits each meet elsewhere too if they are near.  Every link is verified.

Defined results: a null text is the empty text; texts without words have fingerprint 0 and
link like any other.  A null id is never a component's smallest id unless all ids of the
component are null.  Repeated rows are equal texts.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..missing import quoted
from ..session import materialize
from .common import corpus_table, free_name
from .components import component_roots
from .exact_dedup import text_digest
from .near_copies import near_copy_classes

RADIUS = 3
SEED = 42  # fixed value of the shingle hash
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, A-Z lower-cased."""
    words = text.encode().lower().split()  # for bytes: ASCII letters and the six blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (ends[: len(words) - shingle + 1] - np.fromiter(map(len, words[: len(words) - shingle + 1]), np.int64)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())]
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    value = 0
    for lane in range(8):  # bits are counted per byte value
        ones = np.bincount(lanes[:, lane], minlength=256) @ _BYTE_BITS
        for bit in np.flatnonzero(2 * ones > len(hashes)):
            value |= 1 << (8 * lane + int(bit))
    return value


def fingerprints(
    docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, fingerprint`` (the 64 bits as bigint) for each document, without a shuffle."""
    narrow = docs.select(quoted(id_col).cast("bigint").alias("id"), quoted(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (fingerprint(t.as_py() or "", shingle) for t in batch.column("text"))
            bits = np.fromiter(values, np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bits)], names=["id", "fingerprint"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("fingerprint", T.LongType())])
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _mask(*bits: int) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _flips(fp: Column) -> Column:
    """Array of the variants that a fingerprint emits."""
    one = [_mask(i) for i in range(64)]
    two = [_mask(i, j) for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
    masks = F.when(F.bit_count(fp) % 2 == 1, F.array(*map(F.lit, [0, *one, *two]))).otherwise(F.array(*map(F.lit, one)))
    return F.explode(masks)


def ball_links(distinct: DataFrame, fp: str = "fingerprint") -> DataFrame:
    """Links ``a, b`` between distinct fingerprints of a table that holds each once: all at
    distance 3 or less, and enough of them to connect all that are that near."""
    flipped = distinct.select(F.col(fp).alias("fp"), _flips(F.col(fp)).alias("mask"))
    variants = flipped.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    # A group holds no more than the fingerprints within two bits of the variant: 2081.
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("variant"))) > 1
    group = Window.partitionBy("variant").orderBy(far, "fp")
    met = variants.withColumn("hub", F.first("fp").over(group))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))).between(1, RADIUS)
    return met.where(near).select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def near_components(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, fingerprint, component_id`` from a table of fingerprints: components of the
    links at distance 3 or less, named by their smallest id."""
    prints = materialize(prints, "fingerprints")
    distinct = prints.groupBy("fingerprint").agg(F.min(quoted(id_col)).alias("least"))
    distinct = materialize(distinct, "distinct")
    # Each row is about to become hundreds: the small files, which few tasks read, go to all tasks.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = component_roots(ball_links(distinct.repartition(tasks, "fingerprint")))
    # Fingerprints without a neighbour are their own component.
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.join(named, "root").select("fingerprint", "component_id"), "classes")
    return prints.join(classes, "fingerprint").select(quoted(id_col), "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component with all its columns: that of the smallest id, a null id being
    the largest; of those with one id the text with the smallest digest.  Repeated rows are one.
    Components are those of ``near_copies``: five-word shingles, similarity 0.8 or more, not those of
    fingerprints."""
    id_, text = quoted(id_col), quoted(text_col)
    found = near_copy_classes(docs, id_col, text_col)
    best = F.min(F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.col("digest")))
    mark, absent, known = keys = [free_name(docs, x) for x in ("digest", "id_absent", "id_known")]
    stay = found.groupBy("root").agg(best.alias("best")).select(
        F.col("best.digest").alias(mark), F.col("best.col1").alias(absent), F.col("best.col2").alias(known)
    )
    whole = docs.withColumns(
        {mark: text_digest(text), absent: id_.isNull(), known: F.coalesce(id_.cast("bigint"), F.lit(0))}
    )
    picked = whole.join(stay.hint("merge"), keys, "left_semi").dropDuplicates(keys)
    return picked.select(*[quoted(c) for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(fingerprints(corpus_table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLE: dict[str, str] = {}
