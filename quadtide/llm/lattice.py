"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected on random 8-dimensional subspaces, scaled, shifted and decoded to the
nearest point of the E8 lattice; each of TABLES subspaces is a table, and the decoded point (with
the label and the dimension) is the vector's cell there. Besides its own cell a vector probes the
PROBES nearest other lattice points, which are its cell plus those of the 240 shortest lattice
vectors that lie most in the direction of its offset. Two vectors meet where one's own cell is
among the other's cells; pairs that meet are verified by their cosine in double precision.

Equal vectors of a label are one class with a multiplicity. A bucket returns, for each member, how
many vectors it links with, counting a pair only in the first table and cell where it meets, and a
spanning forest of its links: a dense cluster of n vectors gives n rows and not n * n pairs, and a
large bucket is split into pairs of blocks, each a group of its own.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or has a
null label, links with nothing and is its own component; vectors of different dimension don't link;
each row is a vector, so a repeated row links with its repetition; a null vec_id is no one's
component id unless all of a component have none.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked
from .common import materialize, prepare
from .components import components

TABLES, PROBES, SCALE = 4, 4, 2.0  # a pair at cosine 0.98 meets in a table with probability 0.96
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or all 1/2 or -1/2 with an even number of signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        off = x[odd] - r[odd]
        k = np.argmax(np.abs(off), 1)
        r[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: the nearer of the two cosets' nearest."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(maxsize=8)
def _tables(dim: int, tables: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A projection (dim x 8, orthonormal, scaled so that lengths hold on average) and a shift for each table."""
    rng, out = np.random.default_rng(8 * 1_000_003 + dim), []
    for _ in range(tables):
        basis, _ = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))
        out.append((basis[:dim] * np.sqrt(max(dim, 8) / 8), rng.random(8) * 2))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cells(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Hashes of the cells (rows x tables x 1 + probes); the own cell comes first."""
    n, dim = unit.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t, (basis, shift) in enumerate(_tables(dim, tables)):
        y = scale * (unit @ basis) + shift
        own = nearest_e8(y)
        toward = (y - own) @ ROOTS.T
        near = np.argpartition(-toward, probes, 1)[:, :probes] if probes else np.zeros((n, 0), int)
        points = np.concatenate([own[:, None, :], own[:, None, :] + ROOTS[near]], 1)
        code = np.rint(2 * points).astype(np.int64).view(np.uint64)
        key = _mix(np.broadcast_to((label.astype(np.int64).view(np.uint64) * _FOLD + np.uint64(t * 4099 + dim))[:, None], code.shape[:2]).copy())
        for k in range(8):
            key = _mix(key * _FOLD + code[:, :, k])
        out[:, t] = key
    return out


def _usable(values) -> np.ndarray | None:
    """The unit vector, or None."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if not top:
        return None
    x = x / top  # no overflow in the squares
    return x / np.sqrt((x * x).sum())


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the edges that join two trees, in order."""
    parent, out = list(range(n)), []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[y] = x
            out.append(k)
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label)."""
    prepare(vectors.sparkSession)
    import hashlib

    def normalise(batches):
        for b in batches:
            digest, unit = [], []
            for raw, label in zip(b.column("embedding").to_pylist(), b.column("label").to_pylist()):
                x = None if label is None else _usable(raw)
                if x is None:
                    digest.append(None), unit.append(None)
                else:
                    body = np.asarray(raw, "<f8").tobytes()
                    digest.append(hashlib.blake2b(body + str(label).encode(), digest_size=16).digest())
                    unit.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(digest, pa.binary()), pa.array(unit, pa.binary())], ["vec_id", "label", "digest", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = materialize(rows.mapInArrow(normalise, "vec_id long, label long, digest binary, unit binary"), "lattice-units")
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.min("label").alias("label"), F.min("unit").alias("unit"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")  # written, so a node keeps its number

    where = materialize(nodes.select("node", "label", "unit").mapInArrow(_placed(tables, probes, scale, rows=True), "cell long, own boolean, node long"), "lattice-cells")
    # cells with two members of which one lives there
    busy = where.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("lived")).where("n > 1 AND lived").select("cell", "n")
    carried = nodes.select("node", "label", "unit").mapInArrow(_placed(tables, probes, scale, rows=False), "node long, unit binary, cells binary").join(nodes.select("node", "many"), "node")
    met = where.join(busy, "cell").join(carried, "node")
    width = 1 + probes

    def verify(left, right, same):
        def part(p):
            return np.asarray(p["node"]), np.asarray(p["many"]), np.asarray(p["own"], bool), np.frombuffer(b"".join(p["unit"]), np.float64).reshape(len(p["node"]), -1), np.frombuffer(b"".join(p["cells"]), np.uint64).reshape(len(p["node"]), tables, width)

        na, ma, oa, xa, ca = part(left)
        nb, mb, ob, xb, cb = part(right)
        cell = np.uint64(np.int64(left["cell"][0]).view(np.uint64)) if len(left["cell"]) else np.uint64(0)
        # cosines of unit vectors, in stripes of bounded size
        got_a, got_b = [], []
        for lo in range(0, len(na), 512):
            cos = xa[lo: lo + 512] @ xb.T
            i, j = np.nonzero((cos >= least - 1e-12) & (oa[lo: lo + 512, None] | ob[None, :]))
            i = i + lo
            if same:
                i, j = i[i < j], j[i < j]
            got_a.append(i), got_b.append(j)
        i, j = np.concatenate(got_a), np.concatenate(got_b)
        if not len(i):
            return
        exact = np.einsum("ij,ij->i", xa[i], xb[j]) >= least
        i, j = i[exact], j[exact]
        # the first table and cell where a pair meets counts it
        first = np.zeros(len(i), bool)
        for lo in range(0, len(i), 4096):
            s = slice(lo, lo + 4096)
            swap = (na[i[s]] > nb[j[s]])[:, None, None]  # one order for a pair, wherever it meets
            a, b = np.where(swap, cb[j[s]], ca[i[s]]), np.where(swap, ca[i[s]], cb[j[s]])
            hits_a, hits_b = a == b[:, :, :1], b == a[:, :, :1]  # a's cells that are b's own; b's that are a's own
            hits = np.concatenate([hits_a, hits_b], 2).reshape(len(a), -1)
            keys = np.concatenate([a, b], 2).reshape(len(a), -1)
            first[s] = keys[np.arange(len(a)), hits.argmax(1)] == cell
        names = np.concatenate([na, nb])
        ends, inverse = np.unique(names, return_inverse=True)
        x, y = inverse[i], inverse[len(na) + j]
        links = np.bincount(x[first], mb[j[first]], len(ends)) + np.bincount(y[first], ma[i[first]], len(ends))
        some = np.flatnonzero(links)
        yield np.zeros(len(some), np.int64), ends[some], links[some].astype(np.int64)
        tree = _forest(len(ends), x, y)
        yield np.ones(len(tree), np.int64), ends[x[tree]], ends[y[tree]]

    found = materialize(blocked(met, "cell", "n", "node", verify, "kind long, a long, b long"), "lattice-links")
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "node")
    comp = components(found.where("kind = 1").select("a", "b"), "lattice")
    least_id = nodes.select("node", "rep").join(comp.withColumnRenamed("id", "node"), "node").groupBy("comp").agg(F.min("rep").alias("least_id"))
    info = nodes.select("node", "digest", "rep", "many").join(links, "node", "left").join(comp.withColumnRenamed("id", "node"), "node", "left").join(least_id, "comp", "left")
    info = materialize(info.select("digest", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least_id", "rep").alias("least_id")).where("n_links > 0"), "lattice-info")
    out = rows.select("vec_id", "digest").join(info, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _placed(tables: int, probes: int, scale: float, rows: bool):
    """rows: a row (cell, own, node) for each cell; else a row (node, unit, cells) for each vector."""

    def place(batches):
        for b in batches:
            ids, unit, label = b.column("node").to_numpy(zero_copy_only=False), b.column("unit").to_pylist(), b.column("label").to_numpy(zero_copy_only=False)
            sizes = np.array([len(u) for u in unit])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(unit[k] for k in at), np.float64).reshape(len(at), -1)
                c = cells(x, label[at], tables, probes, scale)
                if rows:
                    rep = np.repeat(ids[at], c.shape[1] * c.shape[2])
                    own = np.tile(np.arange(c.shape[2]) == 0, len(at) * c.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(c.reshape(-1).view(np.int64)), pa.array(own), pa.array(rep)], ["cell", "own", "node"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([unit[k] for k in at], pa.binary()), pa.array([r.tobytes() for r in c], pa.binary())], ["node", "unit", "cells"])

    return place
