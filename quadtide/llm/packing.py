"""Best-fit packing with a swap-based local search.

Documents are tokenised whole, an end id is added, and only those over the sequence length are cut,
into pieces of that length. Pieces are dealt evenly into shards of a bounded number of documents;
in a shard, best-fit-decreasing gives a first packing, and a local search then works on the underfull
sequences, emptiest first: a piece of it moves to another underfull sequence that is at least as full,
or changes places with one shorter piece there, or any two of its pieces with one there, or one with
any two there. Each step must fit and raises the sum of squared fills, as the fuller sequence gets
fuller; a sequence that loses its last piece goes. The search ends at the least number that the
lengths allow, where no step is left, or after STEPS steps for each piece.

A shard's emptiest sequence, and those at most half full, are packed again together with those of the
other shards, in fewer and fewer shards of the same bounded size until there is one. So the whole has
about as many sequences as one search over everything would give, and no task holds more than a shard.

Defined cases: a null or empty text is the end id alone; a null doc_id and repeated rows are packed
like any others; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bestfit import best_fit_decreasing
from .common import materialize, prepare
from .tokens import ids_of

SEQUENCE = 2048
#: Documents of a shard, on average.
SHARD_DOCS = 8192
#: Steps of the local search for each piece of a shard, at most. The search stops by itself, as each step
#: raises the sum of squared fills; this bounds its time (about a millisecond a step).
STEPS = 1.0

_PIECES = "shard int, doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PACKED = _PIECES.removeprefix("shard int, ") + ", sequence_id long, offset long, open boolean"


def pieces_of(docs: DataFrame, path: str, capacity: int, shards: int, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document, dealt evenly into shards."""

    def apply(batches):
        turn = None
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = ids_of(text, path) + int(end_id).to_bytes(4, "little")
                if turn is None:  # partitions begin at different shards
                    turn = zlib.crc32(raw + str(doc).encode())
                n = len(raw) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = raw[4 * start: 4 * (start + capacity)]
                    for col, v in zip(rows, (turn % shards, doc, piece, start, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
                    turn += 1
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["shard", "doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(apply, _PIECES)


class _Bins:
    """Items of underfull bins, kept sorted by bin and size, so that the least item of a bin from a size
    up is one binary search for all bins at once."""

    def __init__(self, size: np.ndarray, home: np.ndarray, fill: np.ndarray, capacity: int):
        self.size, self.home, self.fill, self.capacity = size, home, fill, capacity
        self.order = np.lexsort((size, home))

    def move(self, out: list[int], back: list[int], a: int, b: int) -> None:
        delta = int(self.size[out].sum() - self.size[back].sum())
        self.home[out], self.home[back] = b, a
        self.fill[a] -= delta
        self.fill[b] += delta
        self.order = np.lexsort((self.size, self.home))

    def step(self, a: int) -> tuple[list[int], list[int], int] | None:
        """(items out of a, items back, the other bin): the first step that fits and fills a bin that is
        at least as full as a further; None if there is none."""
        size, home, fill, c = self.size, self.home, self.fill, self.capacity
        mine = np.flatnonzero(home == a)
        mine = mine[np.lexsort((mine, -size[mine]))]
        room = np.where((fill > 0) & (fill >= fill[a]), c - fill, -1)
        room[a] = -1
        if room.max() < 1:
            return None
        one = mine[np.r_[True, size[mine][1:] != size[mine][:-1]]]  # items of a size are alike
        for i in one:  # a move: best fit
            ok = np.flatnonzero(room >= size[i])
            if len(ok):
                return [i], [], ok[np.argmin(room[ok])]
        space = room[home]
        for i in one:  # one for one
            j = _best(size[i] - size, space)
            if j is not None:
                return [i], [j], home[j]
        sums: dict[int, tuple[int, int]] = {}  # two of mine: pairs of a sum are alike
        for x in range(len(mine)):
            for y in mine[x + 1:][np.r_[True, size[mine[x + 1:]][1:] != size[mine[x + 1:]][:-1]]] if x + 1 < len(mine) else ():
                sums.setdefault(int(size[mine[x]] + size[y]), (mine[x], y))
        for total, two in sums.items():
            j = _best(total - size, space)
            if j is not None:
                return list(two), [j], home[j]
        key = home[self.order] * (c + 1) + size[self.order]
        rest = self.order[room[home[self.order]] > 0]
        for i in one:  # one for two: for each item the least partner in its bin that makes the pair fit
            need = np.maximum(size[i] - room[home[rest]] - size[rest], 1)
            at = np.searchsorted(key, home[rest] * (c + 1) + need)
            at = np.where((at < len(key)) & (self.order[np.minimum(at, len(key) - 1)] == rest), at + 1, at)
            there = at < len(key)
            partner = self.order[np.minimum(at, len(key) - 1)]
            there &= home[partner] == home[rest]
            gain = np.where(there, size[i] - size[rest] - size[partner], 0)
            gain[gain > room[home[rest]]] = 0
            if len(gain) and gain.max() > 0:
                k = int(np.argmax(gain))
                return [i], [int(rest[k]), int(partner[k])], home[rest[k]]
        return None


def _best(gain: np.ndarray, space: np.ndarray) -> int | None:
    """The item with the largest gain over 0 that fits."""
    gain = np.where(gain <= space, gain, 0)
    j = int(np.argmax(gain))
    return j if gain[j] > 0 else None


def local_search(lengths: np.ndarray, bins: np.ndarray, n_bins: int, capacity: int, steps: int) -> np.ndarray:
    """Improves a packing by at most so many steps; the bins of the result have any numbers."""
    least = -(-int(lengths.sum()) // capacity)
    fill = np.bincount(bins, lengths, n_bins).astype(np.int64)
    if n_bins <= least:
        return bins
    bins = bins.copy()
    loose = np.flatnonzero((fill < capacity)[bins])  # items of underfull bins: only these take part
    state = _Bins(lengths[loose].astype(np.int64), bins[loose], fill, capacity)
    alive, stuck, moved = n_bins, np.zeros(n_bins, bool), False
    while steps > 0 and alive > least:
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if not len(open_bins):
            if not moved:
                break
            stuck[:], moved = False, False  # what was stuck may go on, as others have changed
            continue
        a = open_bins[np.argmin(fill[open_bins])]
        while fill[a] and steps > 0:
            found = state.step(a)
            if found is None:
                break
            steps, moved = steps - 1, True
            state.move(found[0], found[1], a, found[2])
        if fill[a]:
            stuck[a] = True
        else:
            alive -= 1
    bins[loose] = state.home
    return bins


def pack_lengths(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each length: best-fit-decreasing, then the local search."""
    bins, n = best_fit_decreasing(lengths, capacity)
    return local_search(lengths, bins, n, capacity, int(STEPS * len(lengths)) + 64)


def pack(docs: DataFrame, path: str, capacity: int = SEQUENCE, end_id: int = 0, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    prepare(docs.sparkSession)
    shards = max(1, -(-docs.count() // shard_docs))
    pieces, turn, done = pieces_of(docs, path, capacity, shards, end_id), 0, []
    while True:
        last = shards == 1
        packed = pieces.groupBy("shard").applyInArrow(_shard_packer(capacity, turn, last), _PACKED)
        if last and not done:
            return packed.drop("open")
        packed = materialize(packed, f"packing-{turn}")
        done.append(packed.where("NOT open").drop("open"))
        if last:
            return reduce(DataFrame.unionByName, done)
        # the emptiest sequences of all shards are packed again, in fewer shards
        left, turn = packed.where("open"), turn + 1
        shards = min(max(1, -(-left.count() // shard_docs)), max(1, shards // 2))
        pieces = left.select(F.pmod(F.xxhash64("sequence_id"), F.lit(shards)).cast("int").alias("shard"), *_PIECES_COLUMNS)


def _shard_packer(capacity: int, turn: int, last: bool):
    """Packs the pieces of a shard. In all turns but the last one, a shard's emptiest sequence and those
    that are at most half full are open."""

    def apply(table):
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy()
        bins = pack_lengths(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - lengths[order] - base
        shard = int(table.column("shard")[0].as_py())
        sequence = (np.int64(turn) << np.int64(58)) + (np.int64(shard) << np.int64(32)) + bins.astype(np.int64)
        fill = np.bincount(bins, lengths)
        fill[fill == 0] = capacity
        again = (2 * fill <= capacity) | ((fill == fill.min()) & (fill < capacity) & (np.arange(len(fill)) == np.argmin(fill)))
        columns = (pa.array(sequence), pa.array(offset), pa.array(again[bins] if not last else np.zeros(len(bins), bool)))
        for name, column in zip(("sequence_id", "offset", "open"), columns):
            table = table.append_column(name, column)
        return table.drop_columns(["shard"])

    return apply
