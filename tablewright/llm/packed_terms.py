"""Counts of terms per group of texts, from the bytes of the texts.

Terms are bucketed by their length.  Up to 8 bytes are packed into one uint64, up to 16 into
two; these buckets are radix-sorted, 16 bits at a time, and counted as runs.  Longer terms lie in a
bucket for each length, sorted by their bytes.  The sorts are stable and texts come in the order of
their groups, so inside the run of a term its texts and groups are runs too, which gives the
number of texts with the term without a table of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD = 8  # bytes in a uint64
PIECE = 4 << 20  # bytes of text that are cut into terms at once
FLUSH = 1 << 20  # runs of (term, text) that are held before they are given out
_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable ascending order of rows of uint64 words, the first word being the highest."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Which rows differ from the row before; the first one does."""
    differs = np.zeros(len(columns[0]), bool)
    differs[:1] = True
    for column in columns:
        differs[1:] |= column[1:] != column[:-1]
    return differs


def _cut(raw: np.ndarray, offsets: np.ndarray, start: int) -> int:
    """End of the piece that starts at ``start``: the last end of a text within reach, else the
    next byte outside terms."""
    stop = start + PIECE
    if stop >= len(raw):
        return len(raw)
    end = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
    if end > start:
        return end
    limit = int(offsets[np.searchsorted(offsets, start, side="right")])
    while stop < limit:
        outside = np.flatnonzero(~_TERM[raw[stop : min(stop + WORD * 1024, limit)]])
        if len(outside):
            return stop + int(outside[0])
        stop += WORD * 1024
    return limit


def _terms(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the terms of a piece; ``bounds`` are ends of texts in it."""
    inside = _TERM[part]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[bounds] = inside[bounds]
    last[bounds - 1] = inside[bounds - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


class TermRuns:
    """Runs of (term, text) by bucket: the number of words for packed terms, else the length."""

    def __init__(self):
        self.buckets: dict[tuple[str, int], list[tuple]] = {}
        self.size = 0

    def add(self, part: np.ndarray, bounds: np.ndarray, texts: np.ndarray) -> None:
        """Count the terms of a piece; ``texts`` are the numbers of the texts between the bounds."""
        starts, lengths = _terms(part, bounds)
        text = texts[np.searchsorted(bounds, starts, side="right")]
        folded = np.zeros(len(part) + 2 * WORD, np.uint8)
        folded[: len(part)] = _FOLD[part]
        at_any = np.ndarray((len(folded) - WORD + 1,), ">u8", folded, 0, (1,))  # the 8 bytes from each byte on
        for words in (1, 2):
            mine = np.flatnonzero((lengths > WORD * (words - 1)) & (lengths <= WORD * words))
            if len(mine):
                packed = [at_any[starts[mine] + WORD * i].astype(np.uint64) for i in range(words)]
                rest = (WORD * words - lengths[mine]).astype(np.uint64) * np.uint64(8)
                packed[-1] = packed[-1] >> rest << rest
                self._count(("packed", words), packed, text[mine])
        long = np.flatnonzero(lengths > 2 * WORD)
        long = long[np.argsort(lengths[long], kind="stable")]
        for mine in np.split(long, np.flatnonzero(np.diff(lengths[long])) + 1) if len(long) else []:
            length = int(lengths[mine[0]])
            cells = np.empty((len(mine), length), np.uint8)
            for i, start in enumerate(starts[mine]):
                cells[i] = folded[start : start + length]
            self._count(("long", length), [cells.view(f"S{length}").ravel()], text[mine])

    def _count(self, bucket: tuple[str, int], keys: list[np.ndarray], text: np.ndarray) -> None:
        order = self._order(bucket, keys)
        keys, text = [k[order] for k in keys], text[order]
        first = np.flatnonzero(_changes([*keys, text]))
        count = np.diff(first, append=len(text))
        self.buckets.setdefault(bucket, []).append(([k[first] for k in keys], text[first], count))
        self.size += len(first)

    @staticmethod
    def _order(bucket: tuple[str, int], keys: list[np.ndarray]) -> np.ndarray:
        return radix_order(keys) if bucket[0] == "packed" else np.argsort(keys[0], kind="stable")

    def grouped(self, groups: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Per bucket the lengths of the terms, their bytes, groups, counts and numbers of texts; ``groups``
        has the group of each text, in ascending order."""
        for bucket, pieces in self.buckets.items():
            keys = [np.concatenate(k) for k in zip(*(p[0] for p in pieces))]
            text, count = (np.concatenate([p[i] for p in pieces]) for i in (1, 2))
            if len(pieces) > 1:
                order = self._order(bucket, keys)
                keys, text, count = [k[order] for k in keys], text[order], count[order]
            group = groups[text]
            first = np.flatnonzero(_changes([*keys, group]))
            sums = np.add.reduceat(count, first)
            texts = np.add.reduceat(_changes([*keys, text]).astype(np.int64), first)
            if bucket[0] == "packed":
                cells = np.stack([k[first] for k in keys], axis=1).astype(">u8").view(np.uint8)
                used = cells != 0  # no term holds a zero byte
                yield used.sum(axis=1), cells[used], group[first], sums, texts
            else:
                yield np.full(len(first), bucket[1]), keys[0][first].view(np.uint8), group[first], sums, texts


def group_counts(raw: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Counts of the terms of UTF-8 texts that lie one after another in ``raw``.

    Text i is ``raw[offsets[i]:offsets[i + 1]]`` and belongs to ``groups[i]``, which ascend.  Yields what
    :meth:`TermRuns.grouped` yields; a (term, group) may come more than once, a (term, text) counts in
    one of them only.
    """
    runs, start, end = TermRuns(), 0, len(raw)
    while start < end:
        stop = _cut(raw, offsets, start)
        low = int(np.searchsorted(offsets, start, side="right"))
        high = int(np.searchsorted(offsets, stop, side="left"))
        bounds = offsets[low:high] - start  # ends of texts strictly inside the piece
        runs.add(raw[start:stop], bounds, np.arange(low - 1, high, dtype=np.int64))
        start = stop
        if runs.size >= FLUSH and offsets[np.searchsorted(offsets, stop)] == stop:
            yield from runs.grouped(groups)
            runs = TermRuns()
    yield from runs.grouped(groups)
