"""Set of byte positions in containers of 65536, kept as sorted array, bitmap or runs.

Each container takes the form that needs the fewest bytes: two per position as array, 8192 as
bitmap, four per run.  ``before`` holds the number of positions before each container, so the
k-th position is found by a binary search for its container and a select inside it.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

WIDTH = 1 << 16
BITMAP_BYTES = WIDTH // 8


class ArrayContainer:
    """Sorted positions, two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit for each position, with the number of bits before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(WIDTH, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.ends = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.ends, k, side="right"))
        rest = k - (int(self.ends[at - 1]) if at else 0)
        word = np.unpackbits(self.words[at : at + 1].view(np.uint8), bitorder="little")
        return 64 * at + int(np.flatnonzero(word)[rest])


class RunContainer:
    """First positions of runs, with the number of positions up to the end of each run."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.starts = low[first].astype(np.uint16)
        self.ends = np.append(first[1:], len(low)).astype(np.int64)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.ends, k, side="right"))
        return int(self.starts[at]) + k - (int(self.ends[at - 1]) if at else 0)


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted, distinct positions below 65536."""
    runs = int((np.diff(low, prepend=-2) != 1).sum())
    sizes = {ArrayContainer: 2 * len(low), RunContainer: 4 * runs, BitmapContainer: BITMAP_BYTES}
    return min(sizes, key=sizes.get)(low)


class BoundarySet:
    """Positions given container by container: pairs of container number, in ascending order,
    and sorted distinct positions inside it."""

    def __init__(self, parts: Iterable[tuple[int, np.ndarray]]):
        self.keys, self.containers, counts = [], [], [0]
        for key, low in parts:
            if len(low):
                self.keys.append(key)
                self.containers.append(container(low))
                counts.append(counts[-1] + len(low))
        self.before = np.array(counts, np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest position, counted from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return self.keys[at] * WIDTH + self.containers[at].select(k - int(self.before[at]))
