"""A Bloom filter of 64-bit ids: made by the executors, of bounded size, sent to them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, at most (16 MB).
BITS = 1 << 27
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads nearby ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Three places for each id."""
    h = ids.astype(np.int64).view(np.uint64)
    return np.stack([mix(h * _FOLD + np.uint64(k + 1)) % np.uint64(bits) for k in range(3)])


def build(ids: DataFrame, many: int) -> np.ndarray:
    """The filter of `ids`, a table of one long column with about `many` rows, as 64-bit words; its size
    follows the count up to BITS, so beyond BITS / 8 ids it says yes too often to be of use."""
    (name,) = ids.columns
    bits = min(max(1 << 16, 1 << (16 * many).bit_length()), BITS)

    def mark(batches):
        for b in batches:
            at = np.unique(_places(b.column(name).to_numpy(zero_copy_only=False), bits))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    out = np.zeros(bits // 64, np.uint64)
    got = ids.mapInArrow(mark, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return out


def holds(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be in the filter; never false for one that is."""
    at = _places(ids, 64 * len(table))
    return ((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)
