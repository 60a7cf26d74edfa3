"""Cells and buckets: packed exchange of hashes between groups of documents.

Documents are dealt into cells by a hash, of a few mebibytes of text each, so that a cell
can be worked on with numpy in one task.  What cells have to compare (hashes of text
windows) is packed per cell and bucket, a bucket being a range of hash values: one row holds
thousands of hashes.  A bucket sees the hashes of all cells, each once per cell however often
it occurs there, so a window that a third of all documents share adds one entry per cell.
It answers with one bit per entry, in the order in which the entries came, and the cell
recomputes its entries to read the answer.  Both numbers follow from the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CELL_BYTES = 6 << 20
BUCKET_BYTES = 24 << 20
NO_ID = np.iinfo(np.int64).max  # stands for a null id: larger than all others

PACKED = "cell int, bucket int, entries binary, extra binary"
ANSWER = "cell int, bucket int, kind string, bits binary"


def sizes(docs: DataFrame, text: Column, bucket_share: int = 1) -> tuple[int, int]:
    """Numbers of cells and buckets for the bytes of text that the table holds;
    ``bucket_share`` buckets take the bytes of one."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // CELL_BYTES)), max(1, -(-total * bucket_share // BUCKET_BYTES))


def in_cells(docs: DataFrame, id_column: Column, text_column: Column, cells: int) -> DataFrame:
    """``cell, id, known, text``: ids that are never null, with a mark for those that were not.

    Rows are dealt by id and text: no id, null or repeated, makes one cell large.
    """
    text = F.coalesce(text_column.cast("string"), F.lit(""))
    key = F.coalesce(id_column.cast("bigint"), F.lit(int(NO_ID)))
    return docs.select(
        F.pmod(F.xxhash64(key, text), F.lit(cells)).cast("int").alias("cell"),
        key.alias("id"),
        id_column.isNotNull().alias("known"),
        text.alias("text"),
    )


def sorted_documents(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids, UTF-8 texts and id marks of a cell, in an order that does not depend on the run."""
    texts = [t.encode() for t in table["text"].to_pylist()]
    ids = table["id"].to_numpy()
    known = np.array(table["known"].to_pylist(), bool)
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order], known[order]


def by_bucket(bucket_of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets that occur, each with the places of its entries in order: a cell's work follows its
    entries, however many buckets there are."""
    order = np.argsort(bucket_of, kind="stable")
    starts = np.flatnonzero(np.diff(bucket_of[order], prepend=-1))
    yield from zip(bucket_of[order[starts]].tolist(), np.split(order, starts[1:]) if len(starts) else [])


def pack(cell: int, bucket_of: np.ndarray, columns: Callable[[np.ndarray], tuple[bytes, bytes]]) -> pa.Table:
    """One row per bucket that has entries; ``columns`` packs the entries at the given places,
    which keep their order."""
    rows = [(b, *columns(places)) for b, places in by_bucket(bucket_of)]
    return pa.table(
        {
            "cell": pa.array([cell] * len(rows), pa.int32()),
            "bucket": pa.array([r[0] for r in rows], pa.int32()),
            "entries": pa.array([r[1] for r in rows], pa.binary()),
            "extra": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def unpack_answer(answers: pa.Table, kind: str, bucket_of: np.ndarray) -> np.ndarray:
    """The bit of each entry, from the answers of all buckets to one cell."""
    out = np.zeros(len(bucket_of), bool)
    entries = dict(by_bucket(bucket_of))
    for bucket, named, bits in zip(*(answers[c].to_pylist() for c in ("bucket", "kind", "bits"))):
        if named == kind:
            places = entries[bucket]
            out[places] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(places)).astype(bool)
    return out


def answer_rows(cells: list[int], bucket: int, kind: str, bits: Iterator[np.ndarray]) -> pa.Table:
    return pa.table(
        {
            "cell": pa.array(cells, pa.int32()),
            "bucket": pa.array([bucket] * len(cells), pa.int32()),
            "kind": pa.array([kind] * len(cells), pa.string()),
            "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()),
        }
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
