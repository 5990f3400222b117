"""MinHash near-duplicates with tensored banding.

A text is lower-cased (A-Z) and cut into words at ASCII white space; its set has the distinct
shingles of `width` words, or the whole sequence if there are fewer. Words and shingles are 64-bit
hashes of all their bytes, so set sizes and overlaps are exact but for a collision of such hashes.

Tensored banding: 2 * M small collections of K minhashes each, A_1..A_M and B_1..B_M. Table (i, j)
has the key (A_i, B_j), so M * M tables cost only 2 * M * K minhashes. A pair of similarity s meets
in some table with probability (1 - (1 - s^K)^M)^2: 0.9996 at s = 0.8 and 0.99998 at s = 0.85 with
M = 12 and K = 3; a pair at s = 0.2, as a shared passage makes it, with probability 0.008.

1. Documents with equal sets are one class; a class goes on as its smallest doc_id.
2. A collection's value that no other class has can't meet anything; classes without a shared value
   on either side are done.
3. Each bucket of the M tables (i, i) links its members to one member, picked by a hash so that
   tables pick different ones; the pairs are confirmed on the full sets, and connected components
   are taken.
4. The buckets of all tables (i, j) that still hold several components are looked through for pairs
   across components, each pair in the first table that it shares. The tables (i, 1) to (i, M) are the
   parts of the buckets of A_i, so they are read together where that bucket has at most WHOLE members
   (a fifth of the comparisons), and by their own keys (A_i, B_j) where it is larger, as a passage that
   very many documents share makes it. Pairs whose minhashes agree too seldom don't count (a pair at
   the threshold fails that with probability below 1e-6). The larger of a pair's two components is its
   hub. For each hub, the shown members and outsiders are compared on the full sets, in blocks bounded
   in documents and bytes; an outsider that links with a block gives one link. So every pair that a
   table shows is decided, but a group of copies never becomes all its pairs.

Full sets are made again from the texts for the documents of asked pairs, picked out while reading
by a Bloom filter of bounded size; a false positive there costs a set that nobody asks for. No text
is shuffled.

Defined cases: a null or wordless text has an empty set and links with nothing; rows that share a
doc_id are one node, linked with whatever any of them is; a null doc_id links with nothing, its
component is null and it is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .blocks import blocked
from .bloom import mix as _mix
from .common import attach_group_min, materialize, prepare
from .components import components

M, K = 12, 3
HASHES = 2 * M * K
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_MUL = _RNG.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, HASHES, dtype=np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** k and its inverse for k < n, modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        _POWERS["up"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, _BASE))])
        _POWERS["down"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, _UNBASE))])
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "replace").translate(_LOWER), np.uint8)
    inside = raw != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return _mix((total[end] - total[start]) * down[start])


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = word_hashes(text)
    n = min(width, len(words))
    if not n:
        return words
    out = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        out = out * _FOLD + words[k: len(words) - n + 1 + k]
    return np.unique(_mix(out))


def minhashes(sets: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minhashes of a set that isn't empty."""
    out = np.empty(HASHES, np.uint64)
    for k in range(HASHES):
        out[k] = (sets * _MUL[k] + _ADD[k]).min()
    return (out >> np.uint64(32)).astype(np.uint32)


def overlap_links(a: bytes, b: bytes, percent: int) -> bool:
    """Whether 100 * |A and B| >= percent * |A or B| for sorted sets of 8-byte hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two words of a digest of the set (null if empty) and the minhashes."""

    def apply(batches):
        for b in batches:
            n, d1, d2, sig = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, width)
                n.append(len(s))
                if len(s):
                    d1.append(int(s.sum().view(np.int64)))
                    d2.append(int(np.bitwise_xor.reduce(_mix(s + _FOLD)).view(np.int64)))
                    sig.append(minhashes(s).tobytes())
                else:
                    d1.append(None), d2.append(None), sig.append(None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def _shingle_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """doc_id, n and set of the rows whose doc_id is wanted, and of a few others. More wanted ids than
    the Bloom filter is good for are met by a join instead, which shuffles the texts."""
    docs = docs.where("doc_id IS NOT NULL")
    many = wanted.count()
    if many > bloom.BITS // 8:
        return docs.join(wanted, "doc_id", "left_semi").mapInArrow(lambda batches: (_set_rows(b, width) for b in batches), _SETS).where("n > 0")
    words = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted.select("doc_id"), many))

    def apply(batches):
        table = words.value
        for b in batches:
            ids = b.column("doc_id")
            there = bloom.holds(table, ids.fill_null(0).to_numpy(zero_copy_only=False))
            yield _set_rows(b.filter(pa.array(there)), width)

    return docs.mapInArrow(apply, _SETS).where("n > 0")


_SETS = "doc_id long, n long, set binary"


def _set_rows(b: pa.RecordBatch, width: int) -> pa.RecordBatch:
    sets = [shingles(t, width) for t in b.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "set"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets link. Sets are read by two sort-merge joins, so the sets of a
    document with very many partners are split over tasks by the engine's skew join."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    met = pairs.join(right, "b").join(left, "a").where(fits).select("a", "b", "sa", "sb")

    def apply(batches):
        for b in batches:
            keep = [overlap_links(x.as_py(), y.as_py(), percent) for x, y in zip(b.column("sa"), b.column("sb"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(apply, "a long, b long").distinct()


def _likely(percent: int) -> int:
    """The least number of equal minhashes that a pair at the threshold has but with probability < 1e-6."""
    from math import comb

    p, total = percent / 100, 0.0
    for k in range(HASHES + 1):
        total += comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if total > 1e-6:
            return k
    return HASHES


def _sift(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes and minhashes allow a link."""
    least = _likely(percent)
    left = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    met = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def apply(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return met.select("a", "b", "sa", "sb").mapInArrow(apply, "a long, b long")


#: Documents of a block when components are compared, and bytes of their sets; rows and bytes of a lot of
#: small groups.
HUB_BLOCK, HUB_BYTES, LOT_ROWS, LOT_BYTES = 512, 8 << 20, 1024, 8 << 20
#: Components with fewer documents are small.
POOLED = 64
#: Members of an A_i's bucket that are looked at together; larger ones are taken by their parts (A_i, B_j).
WHOLE = 2048


def _hubs(met: DataFrame, comps: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(hub, id, inside): the documents to compare across components; inside is 1 for members of the
    hub, 0 for outsiders, 2 for documents of a pool. met: id, side, val."""
    least = _likely(percent)
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("crowd"))
    known = comps.join(sizes, "comp")
    told = met.where(F.col("side") < M).join(known, "id", "left").select("id", "side", "val", F.coalesce("comp", "id").alias("comp"), F.coalesce("crowd", F.lit(1)).alias("crowd"))
    told = materialize(told, "minhash-told")
    several = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")]
    mixed = materialize(told.groupBy("side", "val").agg(*several).where("lo != hi").select("side", "val", "n"), "minhash-mixed")
    columns = ["key", "side", "part", "n", "id", "comp", "crowd"]
    carried = told.join(mixed.where(F.col("n") <= WHOLE), ["side", "val"]).select(F.xxhash64("side", "val").alias("key"), "side", F.lit(-1).alias("part"), *columns[3:])
    if mixed.where(F.col("n") > WHOLE).limit(1).count():
        second = met.where(F.col("side") >= M).select("id", (F.col("side") - M).alias("part"), F.col("val").alias("other"))
        tables = told.join(mixed.where(F.col("n") > WHOLE).drop("n"), ["side", "val"]).join(second, "id")
        tables = materialize(tables.withColumn("key", F.xxhash64("side", "val", "part", "other")).drop("val", "other"), "minhash-tables")
        apart = tables.groupBy("key").agg(*several).where("lo != hi").select("key", "n")
        carried = carried.unionByName(tables.join(apart, "key").select(*columns))
    carried = carried.join(reps.select(F.col("doc_id").alias("id"), "n_shingles", "sig"), "id")

    def shown(left, right, same):
        ids, comp, crowd, size = (np.asarray(right[c]) for c in ("id", "comp", "crowd", "n_shingles"))
        side, part = left["side"][0], left["part"][0]
        sig = np.frombuffer(b"".join(right["sig"]), np.uint32).reshape(len(ids), HASHES)
        found = []
        for k in range(len(left["id"])):
            own = np.frombuffer(left["sig"][k], np.uint32)
            x, c, m, n = left["id"][k], left["comp"][k], left["crowd"][k], left["n_shingles"][k]
            near = (comp != c) & (np.minimum(size, n) * 100 >= np.maximum(size, n) * percent)
            if same:
                near &= ids > x
            at = np.flatnonzero(near)
            equal = sig[at] == own
            likely = equal.sum(1) >= least
            at, equal = at[likely], equal[likely]
            parts = equal.reshape(-1, 2, M, K).all(3)
            # in the first A_i, with some B_j: in the first B_j if the bucket is of one
            at = at[(parts[:, 0].argmax(1) == side) & parts[:, 1].any(1) & ((part < 0) | (parts[:, 1].argmax(1) == part))]
            if m < POOLED:
                pool = at[crowd[at] < POOLED]
                at = at[crowd[at] >= POOLED]
                key = left["key"][0]
                found += [(key, x, 2)] * bool(len(pool)) + [(key, int(ids[j]), 2) for j in pool]
            if len(at):
                mine = (crowd[at] < m) | ((crowd[at] == m) & (comp[at] > c))  # x's component is the hub
                out = at[mine]
                found += [(c, x, 1)] * bool(len(out)) + [(c, int(ids[j]), 0) for j in out]
                for j in at[~mine]:
                    found += [(int(comp[j]), int(ids[j]), 1), (int(comp[j]), x, 0)]
        if found:
            got = np.unique(np.array(found, np.int64), axis=0)
            yield got[:, 0], got[:, 1], got[:, 2]

    return blocked(carried, "key", "n", "id", shown, "hub long, id long, inside long").distinct()


def _dealt(part: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of hubs and pools, copied for each pair of blocks that they take part in: hub, pool, id,
    inside, i, j, and lot, lot_i, lot_j, the task group: a pair of blocks, or several undivided hubs.

    Blocks are bounded in documents and in bytes of sets; so are the lots, whose number follows the rows
    that they get."""
    part = part.withColumn("pool", F.col("inside") == 2).join(sets.select(F.col("doc_id").alias("id"), (8 * F.col("n") + 64).alias("bytes")), "id")

    def blocks_of(k: int):
        mine = F.col("inside") == k
        return F.greatest(F.ceil(F.count_if(mine) / HUB_BLOCK), F.ceil(F.coalesce(F.sum(F.when(mine, F.col("bytes"))), F.lit(0)) / HUB_BYTES)).cast("int")

    many = part.groupBy("hub", "pool").agg(blocks_of(1).alias("bi"), blocks_of(0).alias("bo"), blocks_of(2).alias("bp"))
    whole = (F.col("bi") <= 1) & (F.col("bo") <= 1) & (F.col("bp") <= 1)
    dealt = materialize(part.join(many, ["hub", "pool"]).withColumn("whole", whole), "minhash-dealt")
    total = dealt.where("whole").agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    lots = max(1, -(-total[0] // LOT_ROWS), -(-total[1] // LOT_BYTES))
    blocks = F.when(F.col("inside") == 1, F.col("bi")).when(F.col("inside") == 0, F.col("bo")).otherwise(F.col("bp"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    over = lambda n, pair: F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), pair)
    pairs = F.when(F.col("inside") == 1, over("bo", lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))).when(
        F.col("inside") == 0, over("bi", lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))).otherwise(
        over("bp", lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    dealt = dealt.withColumn("at", F.explode(pairs)).select("hub", "pool", "id", "inside", "whole", F.col("at.i").alias("i"), F.col("at.j").alias("j"))
    name = F.xxhash64("hub", "pool")
    lot = F.when(F.col("whole"), F.pmod(name, F.lit(lots))).otherwise(name)
    return dealt.withColumn("lot", lot).withColumn("lot_i", F.when(F.col("whole"), -1).otherwise(F.col("i"))).withColumn("lot_j", F.when(F.col("whole"), -1).otherwise(F.col("j"))).drop("whole")


def _across(part: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components: for each outsider and block of a hub's shown members one, if there
    is any, and in each block of a pool those that join what isn't joined there yet."""
    dealt = _dealt(part, sets).join(sets.select(F.col("doc_id").alias("id"), "set"), "id")

    def decide(table):
        table = table.sort_by([("hub", "ascending"), ("pool", "ascending"), ("i", "ascending"), ("j", "ascending"), ("inside", "descending"), ("id", "ascending")])
        hub, pool, i, j, inside, ids = (table.column(c).to_numpy() for c in ("hub", "pool", "i", "j", "inside", "id"))
        body = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        new = np.flatnonzero(np.r_[True, (hub[1:] != hub[:-1]) | (pool[1:] != pool[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        out = []

        def linked(k: int, every: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            """Which sets of a block link with the set at k."""
            x = body[k]
            place = np.minimum(np.searchsorted(x, every), len(x) - 1)
            common = np.bincount(owner[x[place] == every], minlength=len(sizes))
            return np.flatnonzero(100 * common >= percent * (sizes + len(x) - common))

        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(hub)]):
            mid = hi if pool[lo] else lo + int((inside[lo:hi] == 1).sum())
            if mid == lo or (mid == hi and not pool[lo]) or hi - lo < 2:
                continue
            sizes = np.array([len(body[k]) for k in range(lo, mid)])
            every, owner = np.concatenate(body[lo:mid]), np.repeat(np.arange(mid - lo), sizes)
            if not pool[lo]:  # the members are one component: a link of each outsider will do
                for k in range(mid, hi):
                    met = linked(k, every, owner, sizes)
                    if len(met):
                        out.append((int(ids[k]), int(ids[lo + met[0]])))
                continue
            root = list(range(hi - lo))
            for k in range(lo, hi):
                for m in linked(k, every, owner, sizes).tolist():
                    x, y = k - lo, m
                    while root[x] != x:
                        x = root[x]
                    while root[y] != y:
                        y = root[y]
                    if x != y:
                        root[y] = x
                        out.append((int(ids[k]), int(ids[lo + m])))
        return pa.table([pa.array([min(r) for r in out], pa.int64()), pa.array([max(r) for r in out], pa.int64())], names=["a", "b"])

    return dealt.groupBy("lot", "lot_i", "lot_j").applyInArrow(decide, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text and any others)."""
    prepare(docs.sparkSession)
    sigs = materialize(signatures(docs, width), "minhash-signatures")
    named = sigs.where("doc_id IS NOT NULL AND n_shingles > 0")
    # classes of equal sets: each row with its class, the smallest doc_id that has the set
    member = materialize(attach_group_min(named.select("doc_id", "n_shingles", "d1", "d2"), ["d1", "d2", "n_shingles"], "doc_id", "rep").select("doc_id", "rep"), "minhash-classes")
    # a set's representative may stand in several rows with equal sets
    reps = materialize(named.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "sig").distinct(), "minhash-reps")

    def subkeys(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, 2 * M, K).astype(np.uint64)
            key = np.zeros(x.shape[:2], np.uint64)
            for k in range(K):
                key = _mix(key * _FOLD + x[:, :, k] + np.uint64(1))
            key = _mix(key + np.arange(2 * M, dtype=np.uint64) * _BASE)
            ids = np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), 2 * M)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(2 * M, dtype=np.int32), len(key))), pa.array(key.reshape(-1).view(np.int64))], ["id", "side", "val"])

    subs = materialize(reps.select("doc_id", "sig").mapInArrow(subkeys, "id long, side int, val long"), "minhash-subkeys")
    shared = subs.groupBy("side", "val").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("side", "val")
    met = materialize(subs.join(shared, ["side", "val"], "left_semi"), "minhash-shared")
    live = met.groupBy("id").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where((F.col("lo") < M) & (F.col("hi") >= M)).select("id")
    met = materialize(met.join(live, "id", "left_semi"), "minhash-live")
    # the tables (i, i): both collections of a number, put together
    square = met.groupBy("id", (F.col("side") % M).alias("i")).agg(F.count(F.lit(1)).alias("n"), F.min_by("val", "side").alias("a"), F.max_by("val", "side").alias("b")).where("n = 2").select("id", F.xxhash64("i", "a", "b").alias("key"))
    centres = square.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key")).alias("a"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("key", "a")
    stars = square.join(centres, "key").where("a != id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    asked = materialize(_sift(stars, reps, percent), "minhash-stars")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ends = asked.select(F.col("a").alias("doc_id")).union(asked.select("b")).distinct()
    sets = materialize(_shingle_sets(texts, width, ends), "minhash-sets")
    links = materialize(_confirm(asked, sets, percent), "minhash-links")
    first = components(links, "minhash-first")
    hubs = materialize(_hubs(met.select("id", "side", "val"), first, reps, percent), "minhash-hubs")
    if hubs.limit(1).count():
        lacking = hubs.select(F.col("id").alias("doc_id")).distinct().join(sets.select("doc_id"), "doc_id", "left_anti")
        sets = sets.unionByName(materialize(_shingle_sets(texts, width, lacking), "minhash-sets"))
        links = links.unionByName(materialize(_across(hubs, sets, percent), "minhash-across"))
        last = components(links, "minhash-last")
    else:
        last = first
    # rows that share a doc_id are one node: a doc_id's classes are linked through it
    ids = member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    twice = ids.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.limit(1).count():
        last = components(links.select("a", "b").unionByName(ids), "minhash-ids")
        found = ids.select(F.col("a").alias("doc_id")).distinct().join(last.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    else:
        found = ids.select(F.col("a").alias("doc_id"), "b").join(last.withColumnRenamed("id", "b"), "b", "left").select("doc_id", F.coalesce("comp", "b").alias("comp"))
    out = sigs.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: Ids that are broadcast when duplicates are taken out, at most (about 30 MB).
BROADCAST_IDS = 500_000


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns.

    Rows that share a doc_id but not the text are documents of their own, ordered by doc_id, then by a
    digest of the text: they go only where they are near-duplicates. Of equal texts under one doc_id the
    row that is least by its other columns stays. Rows without words and rows without a doc_id all stay."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1")
    if not repeated.limit(1).count():
        return _without(docs, near_duplicates(docs, width, percent), "doc_id")
    digest = F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.sha2("text", 256))
    worded = F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")) != ""
    texts = docs.select("doc_id", digest.alias("_digest")).where("_digest IS NOT NULL").distinct().orderBy("doc_id", "_digest")
    numbers = materialize(texts.withColumn("_number", F.monotonically_increasing_id()), "minhash-numbers")
    named = docs.withColumn("_digest", digest).join(numbers, ["doc_id", "_digest"], "left").withColumn("_worded", F.coalesce(worded, F.lit(False)))
    named = materialize(named.select("_number", "_worded", *docs.columns), "minhash-named")
    one = named.where("_worded AND _number IS NOT NULL").groupBy("_number").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_number", "_row.*")
    one = materialize(one, "minhash-one")
    kept = _without(one, near_duplicates(one.select(F.col("_number").alias("doc_id"), "text"), width, percent), "_number")
    return kept.select(*docs.columns).unionByName(named.where("NOT _worded OR _number IS NULL").select(*docs.columns))


def _without(docs: DataFrame, spoken: DataFrame, id_col: str) -> DataFrame:
    """docs but for the rows whose id is not kept."""
    gone = materialize(spoken.where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), "minhash-gone")
    if gone.count() <= BROADCAST_IDS:  # else the texts are shuffled by the id
        gone = F.broadcast(gone)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
