"""Substring deduplication with fixed-block anchors.

A passage that repeats for ``window`` words or more holds a whole block of
``(window + 1) // 2`` words at a place that is a multiple of the block length, wherever it
stands in the earlier document.  So each document's non-overlapping blocks are the index,
and every rolling block of every document is a probe.

1. Probes and blocks meet in buckets of their hash.  A hash that is a block somewhere and
   occurs in several cells is a hit; the answer is one bit per probe.
2. Hits are extended: the windows that hold a hit, and they alone, are compared between
   cells by their 64-bit hashes, each with the smallest document that has it.  The answer says
   whether an earlier document in another cell has the window.
3. Inside a cell a block that occurs in two of its documents is a hit, and the windows that hold one are
   compared there.  Removed windows that touch or overlap form the maximal exact repeats.

A window that many documents share adds one entry per cell to a bucket, never a pair of
documents.  Texts are shuffled once; hashes of windows are compared, not words, so two
different windows count as equal with a chance of one in 2**64.

Defined results: a null or blank text has no words.  A document with a null id comes after
all others and is no source of repeats for another null id; rows with one id are no source for each
other.  Texts shorter than the window keep all words.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..missing import quoted
from .common import corpus_table
from .exchange import (
    ANSWER,
    PACKED,
    answer_rows,
    in_cells,
    mix64,
    pack,
    sizes,
    sorted_documents,
    unpack_answer,
)

WINDOW = 13
GROUP = 1 << 20  # bytes of text whose words are hashed at once
_SEEDS = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _group_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a byte array."""
    blank = _BLANK[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.empty(0, np.uint64)
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
    return mix64(np.add.reduceat(_SEEDS[raw[~blank]] * powers[place], firsts) + lengths.astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    counts, parts, group, size = [], [], [], 0
    for text in texts:
        counts.append(len(text.split()))
        at = 0
        while at < len(text):  # a long text is cut at blanks; no word is cut
            end = at + GROUP
            while end < len(text) and not _BLANK[text[end]]:
                end += 1
            group += [text[at:end], b" "]
            size += end - at
            at = end
            if size >= GROUP:
                parts.append(_group_hashes(np.frombuffer(b"".join(group), np.uint8)))
                group, size = [], 0
    parts.append(_group_hashes(np.frombuffer(b"".join(group), np.uint8)))
    return np.concatenate(parts), np.array(counts, np.int64)


class Windows:
    """Windows of ``k`` words of the documents of a cell: hashes and documents of all starts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, k: int):
        doc = np.repeat(np.arange(len(counts)), counts)
        firsts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.empty(0, np.int64)
        place = np.arange(len(words)) - firsts[doc]
        self.starts = np.flatnonzero(place + k <= counts[doc]) if len(words) else np.empty(0, np.int64)
        self.docs, self.place = doc[self.starts], place[self.starts]
        total = np.zeros(len(self.starts), np.uint64)
        for i in range(k):
            total = (total + words[self.starts + i]) * _STEP
        self.hashes = mix64(total)


class _Cell:
    """What every step recomputes from the texts of a cell."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        self.window, self.block, self.buckets = window, (window + 1) // 2, buckets
        self.ids, self.texts, self.known = sorted_documents(table)
        self.words, self.counts = word_hashes(self.texts)
        self.probes = Windows(self.words, self.counts, self.block)
        self.wide = Windows(self.words, self.counts, window)
        # Each probe hash once, with a mark if it is a block here.
        self.grams, self._gram_of = np.unique(self.probes.hashes, return_inverse=True)
        self.is_block = np.zeros(len(self.grams), bool)
        self.is_block[self._gram_of[self.probes.place % self.block == 0]] = True
        self.gram_bucket = (self.grams % np.uint64(buckets)).astype(np.int64)
        # Hits inside the cell: blocks that occur in two documents, which are in order.
        first, last = np.empty(len(self.grams), np.int64), np.empty(len(self.grams), np.int64)
        first[self._gram_of[::-1]] = self.probes.docs[::-1]
        last[self._gram_of] = self.probes.docs
        self.is_hit = self.is_block & (first < last)

    def pack_probes(self, cell: int) -> pa.Table:
        short = (self.grams >> np.uint64(32)).astype("<u4")  # the bucket holds the other bits
        return pack(
            cell,
            self.gram_bucket,
            lambda at: (short[at].tobytes(), np.packbits(self.is_block[at]).tobytes()),
        )

    def _holding(self, hits: np.ndarray) -> np.ndarray:
        """Places of the windows that hold one of the grams that are hits."""
        at_word = np.zeros(len(self.words) + 1, np.int64)
        at_word[self.probes.starts + 1] = hits[self._gram_of]
        upto = np.cumsum(at_word)
        # Blocks start at the first window - block + 1 words of the window.
        s = self.wide.starts
        return np.flatnonzero(upto[s + self.window - self.block + 1] > upto[s]) if len(s) else np.empty(0, np.int64)

    def candidates(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that hold a hit of another cell, each once in order of its first document,
        and the place of that first window."""
        places = self._holding(unpack_answer(answers, "probe", self.gram_bucket))
        _, first = np.unique(self.wide.hashes[places], return_index=True)
        places = places[np.sort(first)]
        return self.wide.hashes[places], places

    def pack_windows(self, cell: int, answers: pa.Table) -> pa.Table:
        hashes, places = self.candidates(answers)
        docs = self.ids[self.wide.docs[places]]

        def columns(at: np.ndarray) -> tuple[bytes, bytes]:
            own, counts = np.unique(docs[at], return_counts=True)  # entries are in order of their documents
            return hashes[at].tobytes(), own.astype("<i8").tobytes() + counts.astype("<i8").tobytes()

        return pack(cell, (hashes % np.uint64(self.buckets)).astype(np.int64), columns)

    def removed_words(self, answers: pa.Table) -> np.ndarray:
        """Whether each word is covered by a window that starts in an earlier document."""
        hashes, _ = self.candidates(answers)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        elsewhere = np.sort(hashes[unpack_answer(answers, "window", bucket)])
        gone = np.zeros(len(self.wide.starts), bool)
        near = self._holding(self.is_hit)
        _, first, back = np.unique(self.wide.hashes[near], return_index=True, return_inverse=True)
        ids = self.ids[self.wide.docs[near]]  # documents are in order of their ids
        gone[near] = ids > ids[first][back]
        gone |= _among(self.wide.hashes, elsewhere)
        cover = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(cover, self.wide.starts[gone], 1)
        np.add.at(cover, self.wide.starts[gone] + self.window, -1)
        return np.cumsum(cover)[:-1] > 0


def _meet_probes(bucket: int, table: pa.Table) -> pa.Table:
    """One bit per probe: whether it is a block somewhere and occurs in several cells."""
    cells = table["cell"].to_pylist()
    probes = [np.frombuffer(x, "<u4") for x in table["entries"].to_pylist()]
    marks = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table["extra"].to_pylist(), probes)]
    together = np.sort(np.concatenate(probes))
    shared = np.unique(together[1:][together[1:] == together[:-1]])
    blocks = np.unique(np.concatenate([p[m] for p, m in zip(probes, marks)]))
    hits = np.intersect1d(shared, blocks, assume_unique=True)
    return answer_rows(cells, bucket, "probe", (_among(p, hits) for p in probes))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.searchsorted(ordered, values).clip(max=len(ordered) - 1)] == values


def _meet_windows(bucket: int, table: pa.Table) -> pa.Table:
    """One bit per window: whether a document of another cell that has it is earlier."""
    cells = table["cell"].to_pylist()
    hashes = [np.frombuffer(x, "<u8") for x in table["entries"].to_pylist()]
    docs = []
    for x in table["extra"].to_pylist():
        own, counts = np.frombuffer(x, "<i8").reshape(2, -1)
        docs.append(np.repeat(own, counts))
    flat, ids = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((ids, flat))
    first = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
    least = np.empty_like(ids)
    least[order] = ids[order][np.flatnonzero(first)[np.cumsum(first) - 1]]
    ends = np.cumsum([len(h) for h in hashes])[:-1]
    return answer_rows(cells, bucket, "window", (d > m for d, m in zip(docs, np.split(least, ends))))


OUTPUTS = {
    "n_words": ("bigint", pa.int64()),
    "n_removed": ("bigint", pa.int64()),
    "spans": ("array<struct<start bigint, end bigint>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    "kept_text": ("string", pa.string()),
    "kept_sha256": ("string", pa.string()),
}


def _document(words: list[bytes], gone: np.ndarray) -> dict:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    kept = b" ".join(compress(words, (~gone).tolist()) if len(edges) else words)
    return {
        "n_words": len(words),
        "n_removed": int(gone.sum()),
        "spans": [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])],
        "kept_text": kept.decode(),
        "kept_sha256": hashlib.sha256(kept).hexdigest(),
    }


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    outputs: tuple[str, ...] = ("n_words", "n_removed", "spans", "kept_text"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col`` and the chosen ``outputs`` per document: words, removed words, the maximal
    removed runs as word places (end exclusive), and the words that are left, joined by spaces."""
    cells, buckets = sizes(docs, quoted(text_col))
    dealt = in_cells(docs, quoted(id_col), quoted(text_col), cells)
    grouped = dealt.groupBy("cell")

    def probes(key, table):
        return _Cell(table, window, buckets).pack_probes(key[0].as_py())

    def windows(key, left, right):
        return _Cell(left, window, buckets).pack_windows(key[0].as_py(), right)

    def result(left, right):
        cell = _Cell(left, window, buckets)
        gone = np.split(cell.removed_words(right), np.cumsum(cell.counts)[:-1]) if len(cell.counts) else []
        rows = [_document(text.split(), flags) for text, flags in zip(cell.texts, gone)]
        ids = pa.array(cell.ids, pa.int64(), mask=~cell.known)
        return pa.table({"id": ids, **{name: pa.array([r[name] for r in rows], OUTPUTS[name][1]) for name in outputs}})

    met_probes = grouped.applyInArrow(probes, PACKED).groupBy("bucket").applyInArrow(
        lambda key, table: _meet_probes(key[0].as_py(), table), ANSWER
    )
    met_windows = (
        grouped.cogroup(met_probes.groupBy("cell"))
        .applyInArrow(windows, PACKED)
        .groupBy("bucket")
        .applyInArrow(lambda key, table: _meet_windows(key[0].as_py(), table), ANSWER)
    )
    answers = met_probes.unionByName(met_windows)
    schema = ", ".join(["id bigint", *[f"{name} {OUTPUTS[name][0]}" for name in outputs]])
    return grouped.cogroup(answers.groupBy("cell")).applyInArrow(result, schema).withColumnRenamed("id", id_col)


def op2_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus_table(spark, sf_dir, "documents")
    return remove_repeats(docs, outputs=("n_words", "n_removed", "kept_sha256"))


QUERIES = {"op2_anchors": op2_anchors}
ORACLE: dict[str, str] = {}
