"""Byte-level BPE with a segment tree over byte positions.

A text is split by the vocabulary's pattern and every match is merged on its own. The leaf of a
byte position holds the rank of the pair that starts there; an inner node holds the least rank below
it, so the root tells the next merge and a walk down finds its leftmost place. A merge changes three
leaves and their paths: n bytes take O(n log n), however the merges fall. Matches repeat, so a
bounded table keeps the ids of short ones.

Decoding maps ids to their bytes. Defined cases: a null text counts as empty; an empty text has no
ids and decodes to no bytes; repeated rows and a null doc_id stay as they are.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import prepare

#: Matches of up to so many bytes are remembered, the first so many of them: frequent ones come early.
REMEMBERED_BYTES, REMEMBERED = 64, 500_000
_NONE = 1 << 40


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: always the leftmost pair of least rank is merged next."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << max(n - 1, 1).bit_length()
    parts = [piece[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i:i + 2], _NONE)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            low = tree[2 * k] if tree[2 * k] <= tree[2 * k + 1] else tree[2 * k + 1]
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] < _NONE:
        k, low = 1, tree[1]
        while k < size:
            k = 2 * k if tree[2 * k] == low else 2 * k + 1
        i = k - size
        j = after[i]
        parts[i] += parts[j]
        after[i] = m = after[j]
        parts[j] = b""
        if m < n:
            before[m] = i
        put(j, _NONE)
        put(i, get(parts[i] + parts[m], _NONE) if m < n else _NONE)
        if before[i] >= 0:
            h = before[i]
            put(h, get(parts[h] + parts[i], _NONE))
    return [ranks[p] for p in parts if p]


class _Remembered(dict):
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, match: str) -> tuple[int, ...]:
        raw = match.encode("utf-8", "replace")
        ids = tuple(merge(raw, self.ranks))
        if len(raw) <= REMEMBERED_BYTES and len(self) < REMEMBERED:
            self[match] = ids
        return ids


class Codec:
    """Encodes and decodes with the ranks of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for raw, rank in self.ranks.items():
            self.bytes[rank] = raw
        self.decimal = [str(k) for k in range(len(self.bytes))]
        self.find = regex.compile(pattern).findall
        self.known = _Remembered(self.ranks)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row; path must exist on every executor."""
    prepare(docs.sparkSession)

    def apply(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of each row of encode()'s result; null ids count as none."""
    prepare(encoded.sparkSession)

    def apply(batches):
        c = codec(path, pattern)
        for b in batches:
            raw = [c.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(apply, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, raw binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encodes, decodes the ids, digests both."""
    prepare(docs.sparkSession)

    def apply(batches):
        c = codec(path, pattern)
        for b in batches:
            n, enc, dec = [], [], []
            for t in b.column("text").to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids))
                enc.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                dec.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
