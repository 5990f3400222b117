"""Work on the pairs of rows in a bucket without a task that holds an unbounded bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block: a task holds two blocks at a time.
BLOCK = 2048


def blocked(rows: DataFrame, key: str, count: str, order: str, each, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Calls each(left, right, same) for pairs of blocks of every bucket and returns what it yields.

    rows: with the bucket's key and its number of rows, count. A bucket of n rows is dealt by a hash
    of `order` into b = ceil(n / BLOCK) blocks; every unordered pair of blocks is a group of its own,
    so a hot bucket spreads over b * (b + 1) / 2 groups of about 2 * BLOCK rows each. left and right
    are dicts of numpy arrays (or lists, for binary columns); same: they are the same block. each
    yields tuples of arrays in the order of schema's columns.
    """
    dealt = rows.withColumn("_b", F.ceil(F.col(count) / BLOCK).cast("int")).withColumn("_own", F.pmod(F.xxhash64(order), F.col("_b")).cast("int"))
    # block k takes part in the pairs (k, k..b-1) and (0..k-1, k)
    pairs = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda j: F.struct(F.least("_own", j).alias("i"), F.greatest("_own", j).alias("j")))
    dealt = dealt.withColumn("_pair", F.explode(pairs)).withColumn("_i", F.col("_pair.i")).withColumn("_j", F.col("_pair.j")).drop("_pair")
    names = [f.split()[0] for f in schema.split(", ")]

    def apply(table):
        own, i, j = (table.column(c).to_numpy() for c in ("_own", "_i", "_j"))
        parts = []
        for want in (i[0], j[0]):
            part = table.filter(pa.array(own == want))
            parts.append({c: part.column(c).to_pylist() if pa.types.is_binary(part.schema.field(c).type) or pa.types.is_list(part.schema.field(c).type) else part.column(c).to_numpy() for c in part.column_names})
        same = i[0] == j[0]
        got = list(each(*parts, same)) if len(parts[0][order]) and len(parts[1][order]) else []
        cols = [np.concatenate([np.atleast_1d(g[k]) for g in got]) if got else np.zeros(0) for k in range(len(names))]
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        return pa.table([pa.array(c).cast(kinds[f.split()[1]]) for c, f in zip(cols, schema.split(", "))], names=names)

    return dealt.groupBy(key, "_i", "_j").applyInArrow(apply, schema)
