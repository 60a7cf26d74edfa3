"""Substring deduplication of bytes with a run-length suffix index.

Every window of ``length`` bytes has an anchor, the 32 bytes in it with the smallest hash.
Equal windows have equal anchors at equal places, so the runs of windows that share an
anchor (segments, some 35 windows each) are what documents have to be compared by.

1. Segments meet in buckets of their anchor's hash, as 64-bit hashes, each once per cell.  The
   answer says of each whether an equal segment is earlier elsewhere (then all its windows
   are repeats), and whether its anchor has different segments.
2. Of the segments that have no earlier equal and share their anchor with different ones, the
   bytes go to the bucket, which builds a run-length index of them: suffix order, Burrows-Wheeler
   transform cut into runs, and for the ends of runs the place, the place of the suffix before,
   and the length of their match.  Streaming over the text from sample to sample gives
   every place its matching statistics: the longest match with the suffix before it and
   where that is.  Places that match for ``length`` bytes or more form classes, of which the first
   place in document order stays.
3. An anchor with more than ``CROWD`` different segments would make one bucket grow with the
   corpus; windows of these are met by 64-bit hashes of single windows instead, each once per cell.

What a third of all documents share is one entry per cell.  Texts are shuffled once, in cells
of a few mebibytes; long texts are cut into pieces that overlap by a window, which cuts
segments but loses no window.

Rows are dealt to cells by id and text, so the rows of one id, or of none, spread like any others.

Defined results: a null text is empty.  Rows with one id follow each other in order of a 64-bit hash of their
texts, and the earlier counts; null ids come last, as one id.  Matches never cross rows.  An empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..missing import quoted
from .anchors import _among
from .common import corpus_table
from .exchange import ANSWER, PACKED, answer_rows, by_bucket, in_cells, mix64, pack, sizes, sorted_documents, unpack_answer

LENGTH = 100
ANCHOR = 32
PIECE = 1 << 20  # window starts that are hashed at once
CROWD = 512
_PLACE = np.uint64(PIECE * 2 - 1)  # low bits of a key hold a place in a piece
_SEEDS = np.random.default_rng(21).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _STEP), ("down", _BACK)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


class _Hashes:
    """Hashes of any substrings of a piece of text."""

    def __init__(self, raw: np.ndarray):
        up, self._down = _power(len(raw) + 1)
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_SEEDS[raw] * up[: len(raw)], out=self._sums[1:])

    def of(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return mix64((self._sums[ends] - self._sums[starts]) * self._down[starts])


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each run of ``width`` keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class _Cell:
    """Segments of the texts of a cell, recomputed by every step."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        self.length, self.buckets, self.k = length, buckets, min(ANCHOR, length)
        ids, texts, known = sorted_documents(table)
        ties = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        order = np.lexsort((ties, ids))
        self.ids, self.ties, self.known = ids[order], ties[order], known[order]
        self.texts = [texts[i] for i in order]
        parts = [[np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2]
        for doc, text in enumerate(self.texts):
            raw = np.frombuffer(text, np.uint8)
            for at in range(0, max(0, len(raw) - length + 1), PIECE):
                piece = raw[at : at + PIECE + length - 1]
                first, last, anchor, whole = self._segments(piece)
                parts.append([np.full(len(first), doc), first + at, last + at, anchor, whole])
        columns = [np.concatenate(c) for c in zip(*parts)]
        # Segment by segment in document order: document, first and last window start, hashes.
        self.doc, self.first, self.last, self.anchor, self.whole = columns
        _, at = np.unique(self.whole, return_index=True)
        self.own = np.sort(at)  # the first segment of each content
        self.bucket = (self.anchor[self.own] % np.uint64(buckets)).astype(np.int64)

    def _segments(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hashes, width = _Hashes(piece), self.length - self.k + 1
        n = len(piece) - self.k + 1
        grams = hashes.of(slice(0, n), slice(self.k, self.k + n))
        place = _sliding_least((grams & ~_PLACE) | np.arange(n, dtype=np.uint64), width) & _PLACE
        edges = np.flatnonzero(place[1:] != place[:-1]) + 1
        first = np.concatenate(([0], edges))
        last = np.concatenate((edges - 1, [len(place) - 1]))
        at = place[first].astype(np.int64)
        shape = (last - first).astype(np.uint64) * np.uint64(1009) + (at - first).astype(np.uint64)
        whole = mix64(hashes.of(first, last + self.length) + shape * np.uint64(_STEP))
        return first, last, mix64(grams[at]), whole

    def _runs(self, docs: np.ndarray) -> bytes:
        """Ids and ties of documents that are in order, with how often each comes."""
        own, counts = np.unique(docs, return_counts=True)
        return self.ids[own].astype("<i8").tobytes() + self.ties[own].astype("<u8").tobytes() + counts.astype("<i8").tobytes()

    def pack_segments(self, cell: int) -> pa.Table:
        short, whole = (self.anchor[self.own] >> np.uint64(32)).astype("<u4"), self.whole[self.own]
        doc = self.doc[self.own]
        return pack(
            cell, self.bucket, lambda at: (short[at].tobytes() + whole[at].tobytes(), self._runs(doc[at]))
        )

    def read(self, answers: pa.Table):
        """Of the distinct segments: which have an earlier equal elsewhere; places of those that
        are compared by bytes, and of those that are compared by windows."""
        later, mixed, crowded = (
            unpack_answer(answers, kind, self.bucket) for kind in ("later", "mixed", "crowded")
        )
        return later, self.own[~later & mixed & ~crowded], self.own[~later & crowded]

    def windows(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document and start of each window of the segments, in order."""
        parts = [[np.empty(0, np.uint64)] + [np.empty(0, np.int64)] * 2]
        for doc in np.unique(self.doc[segments]):
            raw = np.frombuffer(self.texts[doc], np.uint8)
            for s in segments[self.doc[segments] == doc]:
                a, b = int(self.first[s]), int(self.last[s])
                starts = np.arange(b - a + 1)
                hashes = _Hashes(raw[a : b + self.length]).of(starts, starts + self.length)
                parts.append([hashes, np.full(len(starts), doc), starts + a])
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _window_entries(self, segments: np.ndarray):
        hashes, docs, _ = self.windows(segments)
        _, at = np.unique(hashes, return_index=True)
        at = np.sort(at)
        return hashes[at], docs[at], (hashes[at] % np.uint64(self.buckets)).astype(np.int64) + self.buckets

    def pack_texts(self, cell: int, answers: pa.Table) -> pa.Table:
        """Bytes of segments to the buckets of their anchors; windows to as many further buckets."""
        _, segments, crowd = self.read(answers)

        def texts(at: np.ndarray) -> tuple[bytes, bytes]:
            chosen = segments[at]
            cut = [self.texts[self.doc[s]][self.first[s] : self.last[s] + self.length] for s in chosen]
            return b"".join(cut), np.array([len(cut), *map(len, cut)], "<i8").tobytes() + self._runs(self.doc[chosen])

        bucket = (self.anchor[segments] % np.uint64(self.buckets)).astype(np.int64)
        hashes, docs, wide = self._window_entries(crowd)
        return pa.concat_tables(
            [
                pack(cell, bucket, texts),
                pack(cell, wide, lambda at: (hashes[at].tobytes(), self._runs(docs[at]))),
            ]
        )

    def removed_bytes(self, answers: pa.Table) -> list[np.ndarray]:
        """Of each text, whether each byte is covered by a window that is a repeat."""
        later, segments, crowd = self.read(answers)
        cover = [np.zeros(len(t) + 1, np.int32) for t in self.texts]
        whole = np.ones(len(self.doc), bool)  # equal to an earlier segment, here or elsewhere
        whole[self.own] = later
        for s in np.flatnonzero(whole):
            cover[self.doc[s]][self.first[s]] += 1
            cover[self.doc[s]][self.last[s] + self.length] -= 1
        bucket = (self.anchor[segments] % np.uint64(self.buckets)).astype(np.int64)
        bits = self._text_bits(answers, segments, bucket)
        for s, flags in zip(segments.tolist(), bits):
            self._cover(cover, self.doc[s], self.first[s] + np.flatnonzero(flags))
        hashes, docs, starts = self.windows(crowd)
        own, _, wide = self._window_entries(crowd)
        elsewhere = np.sort(own[unpack_answer(answers, "window", wide)])
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        gone = _among(hashes, elsewhere) | (np.arange(len(hashes)) != first[back])
        for doc in np.unique(docs[gone]):
            self._cover(cover, doc, starts[gone & (docs == doc)])
        return [np.cumsum(c)[:-1] > 0 for c in cover]

    def _cover(self, cover: list[np.ndarray], doc: int, starts: np.ndarray) -> None:
        np.add.at(cover[doc], starts, 1)
        np.add.at(cover[doc], starts + self.length, -1)

    def _text_bits(self, answers: pa.Table, segments: np.ndarray, bucket: np.ndarray) -> list[np.ndarray]:
        sizes_of = self.last[segments] - self.first[segments] + 1
        out, entries = [np.zeros(n, bool) for n in sizes_of], dict(by_bucket(bucket))
        for b, kind, bits in zip(*(answers[c].to_pylist() for c in ("bucket", "kind", "bits"))):
            if kind == "text":
                places = entries[b]
                flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes_of[places].sum())).astype(bool)
                for i, part in zip(places, np.split(flags, np.cumsum(sizes_of[places])[:-1])):
                    out[i] = part
        return out


def _documents(runs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ties of the entries of a row."""
    ids, ties, counts = np.frombuffer(runs, "<i8").reshape(3, -1)
    return np.repeat(ids, counts), np.repeat(ties.view("<u8"), counts)


def _after_first(keys: list[np.ndarray], ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Whether each entry's document comes after the first document of the entries with equal keys."""
    order = np.lexsort((ties, ids, *reversed(keys)))
    new = np.zeros(len(ids), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    after = np.empty(len(ids), bool)
    after[order] = (ids[order] > ids[first]) | ((ids[order] == ids[first]) & (ties[order] > ties[first]))
    return after


def _meet_segments(bucket: int, table: pa.Table) -> pa.Table:
    """Three bits per segment: an earlier equal elsewhere; others of the anchor; too many of them."""
    cells = table["cell"].to_pylist()
    short, whole, docs = [], [], [_documents(x) for x in table["extra"].to_pylist()]
    for x, (d, _) in zip(table["entries"].to_pylist(), docs):
        short.append(np.frombuffer(x, "<u4", len(d)))
        whole.append(np.frombuffer(x, "<u8", len(d), 4 * len(d)))
    ends = np.cumsum([len(d) for d, _ in docs])[:-1]
    anchor, content = np.concatenate(short), np.concatenate(whole)
    ids, ties = (np.concatenate(x) for x in zip(*docs))
    later = _after_first([anchor, content], ids, ties)
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    new_anchor = np.concatenate(([True], a[1:] != a[:-1]))
    new = new_anchor | np.concatenate(([True], c[1:] != c[:-1]))
    number = np.cumsum(new_anchor) - 1
    many = np.empty(len(ids), np.int64)
    many[order] = np.bincount(number, new).astype(np.int64)[number]
    return pa.concat_tables(
        [
            answer_rows(cells, bucket, kind, np.split(bits, ends))
            for kind, bits in (("later", later), ("mixed", many > 1), ("crowded", many > CROWD))
        ]
    )


def _meet_windows(bucket: int, table: pa.Table) -> pa.Table:
    """One bit per window: whether a document of another cell that has it is earlier."""
    cells = table["cell"].to_pylist()
    hashes = [np.frombuffer(x, "<u8") for x in table["entries"].to_pylist()]
    ids, ties = (np.concatenate(x) for x in zip(*map(_documents, table["extra"].to_pylist())))
    later = _after_first([np.concatenate(hashes)], ids, ties)
    return answer_rows(cells, bucket, "window", np.split(later, np.cumsum([len(h) for h in hashes])[:-1]))


END = np.iinfo(np.uint16).max


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a text of symbols, with sampled run ends.

    ``heads`` and ``lengths`` are the runs.  For the first suffix of each run, ``places`` holds its
    place in the text, ``before`` that of the suffix ahead of it in suffix order, which ends the
    run before, and ``matches`` the length of their match.  ``places`` ascends.  Symbols are
    16-bit numbers below 511.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        keys, width = self._keys(symbols)
        order, ranks = self._suffix_order(keys, width)
        heads = symbols[order - 1]
        heads[ranks[0]] = END  # nothing stands before the whole text
        starts = np.concatenate(([0], np.flatnonzero(heads[1:] != heads[:-1]) + 1))
        self.heads, self.lengths = heads[starts], np.diff(np.concatenate((starts, [n])))
        places, before = order[starts], np.where(starts > 0, order[starts - 1], -1)
        matches = np.where(before >= 0, self._match(symbols, keys, width, places, before), 0)
        by_place = np.argsort(places)
        self.places, self.before, self.matches = places[by_place], before[by_place], matches[by_place]
        self.size = n

    @staticmethod
    def _keys(symbols: np.ndarray) -> tuple[np.ndarray, int]:
        """Seven symbols of nine bits from each place on; the end of the text counts as -1, below all."""
        width = 7
        padded = np.zeros(len(symbols) + width, np.uint64)
        padded[: len(symbols)] = symbols.astype(np.uint64) + np.uint64(1)
        keys = np.zeros(len(symbols), np.uint64)
        for i in range(width):
            keys = (keys << np.uint64(9)) | padded[i : i + len(symbols)]
        return keys, width

    @staticmethod
    def _suffix_order(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and the rank of each place, by doubling the compared length."""
        n = len(keys)
        while True:
            order = np.argsort(keys, kind="stable")
            sorted_keys = keys[order]
            new = np.concatenate(([False], sorted_keys[1:] != sorted_keys[:-1]))
            ranks = np.empty(n, np.int64)
            ranks[order] = np.cumsum(new)
            if int(new.sum()) == n - 1:
                return order, ranks
            following = np.zeros(n, np.int64)
            following[: max(0, n - width)] = ranks[width:] + 1
            keys = (ranks.astype(np.uint64) << np.uint64(32)) | following.astype(np.uint64)
            width *= 2

    @staticmethod
    def _match(symbols: np.ndarray, keys: np.ndarray, width: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the matches of the suffixes at two lists of places."""
        n, out, live = len(symbols), np.zeros(len(a), np.int64), np.flatnonzero(b >= 0)
        while len(live):  # by seven symbols
            x, y = a[live] + out[live], b[live] + out[live]
            inside = np.maximum(x, y) < n
            same = np.zeros(len(live), bool)
            same[inside] = keys[x[inside]] == keys[y[inside]]
            whole = same & (np.maximum(x, y) + width <= n)
            out[live[whole]] += width
            live = live[whole]
        live = np.flatnonzero(b >= 0)
        for _ in range(width):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = np.maximum(x, y) < n
            same = np.zeros(len(live), bool)
            same[inside] = symbols[x[inside]] == symbols[y[inside]]
            live = live[same]
            out[live] += 1
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every place, the length of the match with the suffix before it in suffix order and
        the place of that one: those of the sample at or before the place, moved along."""
        gap = np.diff(np.concatenate((self.places, [self.size])))
        moved = np.arange(self.size) - np.repeat(self.places, gap)
        return np.repeat(self.matches, gap) - moved, np.repeat(self.before, gap) + moved


def first_places(symbols: np.ndarray, length: int) -> np.ndarray:
    """Of every place, the first place whose next ``length`` symbols are the same."""
    match, before = RunLengthIndex(symbols).matching_statistics()
    place = np.arange(len(symbols))
    root = np.where(match >= length, before, place)
    while True:  # to the first of the class in suffix order
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further
    least = place.copy()
    np.minimum.at(least, root, place)
    return least[root]


def _meet_texts(bucket: int, table: pa.Table, length: int) -> pa.Table:
    """One bit per window of each segment: whether it is the same as an earlier one."""
    cells, owner, cut, docs = table["cell"].to_pylist(), [], [], []
    for i, (text, extra) in enumerate(zip(table["entries"].to_pylist(), table["extra"].to_pylist())):
        # The number of segments, their lengths, then documents and how many segments each has.
        numbers = np.frombuffer(extra, "<i8")
        n = int(numbers[0])
        lengths = numbers[1 : n + 1]
        cut += [text[e - m : e] for e, m in zip(np.cumsum(lengths).tolist(), lengths.tolist())]
        docs.append(_documents(numbers[n + 1 :].tobytes()))
        owner += [i] * n
    ids, ties = (np.concatenate(x) for x in zip(*docs))
    order = np.lexsort((ties, ids))  # stable: segments of one document come from one cell, in order
    parts, firsts, at = [], np.empty(len(cut), np.int64), 0
    for j in order:
        parts += [np.frombuffer(cut[j], np.uint8).astype(np.uint16) + np.uint16(1), np.zeros(1, np.uint16)]
        firsts[j] = at
        at += len(cut[j]) + 1
    earliest = first_places(np.concatenate(parts), length)
    bits: list[list[np.ndarray]] = [[] for _ in cells]
    for i, first, text in zip(owner, firsts, cut):
        starts = np.arange(first, first + len(text) - length + 1)
        bits[i].append(earliest[starts] < starts)
    return answer_rows(cells, bucket, "text", (np.concatenate(b) for b in bits))


OUTPUTS = {
    "n_bytes": ("bigint", pa.int64()),
    "n_removed": ("bigint", pa.int64()),
    "n_spans": ("bigint", pa.int64()),
    "spans": ("array<struct<start bigint, end bigint>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    "kept_bytes": ("binary", pa.binary()),
    "kept_sha256": ("string", pa.string()),
}


def _document(text: bytes, gone: np.ndarray) -> dict:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(edges) else text
    return {
        "n_bytes": len(text),
        "n_removed": int(gone.sum()),
        "n_spans": len(edges) // 2,
        "spans": [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])],
        "kept_bytes": kept,
        "kept_sha256": hashlib.sha256(kept).hexdigest(),
    }


def remove_repeated_bytes(
    docs: DataFrame,
    length: int = LENGTH,
    outputs: tuple[str, ...] = ("n_bytes", "n_removed", "spans", "kept_bytes"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col`` and the chosen ``outputs`` per document: bytes, removed bytes, the maximal removed
    runs as byte places (end exclusive) and their number, and the bytes that are left."""
    cells, buckets = sizes(docs, quoted(text_col), bucket_share=3)  # an index takes 60 bytes a byte
    grouped = in_cells(docs, quoted(id_col), quoted(text_col), cells).groupBy("cell")

    def segments(key, table):
        return _Cell(table, length, buckets).pack_segments(key[0].as_py())

    def texts(key, left, right):
        return _Cell(left, length, buckets).pack_texts(key[0].as_py(), right)

    def meet(key, table):
        bucket = key[0].as_py()
        return _meet_texts(bucket, table, length) if bucket < buckets else _meet_windows(bucket, table)

    def result(left, right):
        cell = _Cell(left, length, buckets)
        rows = [_document(text, gone) for text, gone in zip(cell.texts, cell.removed_bytes(right))]
        ids = pa.array(cell.ids, pa.int64(), mask=~cell.known)
        return pa.table({"id": ids, **{name: pa.array([r[name] for r in rows], OUTPUTS[name][1]) for name in outputs}})

    met_segments = grouped.applyInArrow(segments, PACKED).groupBy("bucket").applyInArrow(
        lambda key, table: _meet_segments(key[0].as_py(), table), ANSWER
    )
    met_texts = (
        grouped.cogroup(met_segments.groupBy("cell"))
        .applyInArrow(texts, PACKED)
        .groupBy("bucket")
        .applyInArrow(meet, ANSWER)
    )
    answers = met_segments.unionByName(met_texts)
    schema = ", ".join(["id bigint", *[f"{name} {OUTPUTS[name][0]}" for name in outputs]])
    return grouped.cogroup(answers.groupBy("cell")).applyInArrow(result, schema).withColumnRenamed("id", id_col)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus_table(spark, sf_dir, "documents")
    return remove_repeated_bytes(docs, outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"))


QUERIES = {"op8_repeats": op8_repeats}
ORACLE: dict[str, str] = {}
