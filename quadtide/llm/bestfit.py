"""Best-fit-decreasing with a segment tree over free capacities."""

from __future__ import annotations

import numpy as np


class Capacities:
    """Bins by free capacity. A segment tree over 0..capacity tells the least capacity that is at
    least a wanted one and has a bin, in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, free: int, b: int) -> None:
        self.bins.setdefault(free, []).append(b)
        k = self.size + free
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, wanted: int) -> tuple[int, int] | None:
        """(free, bin) of a bin with the least free capacity >= wanted, which leaves the tree."""
        count, k = self.count, self.size + wanted
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):  # up until a right neighbour has a bin
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        free = k - self.size
        while k:
            count[k] -= 1
            k >>= 1
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(bin of each item, number of bins). Lengths are 1..capacity; longer items come first, ties in order."""
    out, tree, n = np.zeros(len(lengths), np.int64), Capacities(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        got = tree.take(size)
        if got is None:
            got, n = (capacity, n), n + 1
        free, b = got
        out[i] = b
        tree.add(free - size, b)
    return out, n
