"""Optional dense ids for terms, and the fixed-size record form of a quad.

Parquet's dictionary pages compress terms already; ids are for exchange with systems that want them.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError
from ..workspace import materialize

POSITIONS = ("s", "p", "o", "g")
#: timestamp (64 bits) and four ids (32 bits), little-endian.
RECORD = struct.Struct("<QIIII")
UNKNOWN = "UNKNOWN"


def build(quads: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(term, id): an id for each distinct term, dense from 0; ids of `known` stay.

    Ids come from a sort by range and per-partition counts, so no task holds all terms."""
    terms = None
    for c in POSITIONS:
        t = quads.select(F.col(c).alias("term"))
        terms = t if terms is None else terms.unionByName(t)
    fresh = terms.where("term IS NOT NULL").distinct()
    begin = 0
    if known is not None:
        fresh = fresh.join(known.select("term"), "term", "left_anti")
        most = known.agg(F.max("id")).first()[0]
        begin = 0 if most is None else most + 1
    spark = quads.sparkSession
    ordered = fresh.sort("term").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ordered = materialize(ordered, "dictionary")
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first")).orderBy("_part").collect()  # one row a partition
    offsets, total = [], begin
    for r in counts:
        offsets.append((r["_part"], total - r["first"]))
        total += r["n"]
    if not offsets:
        made = spark.createDataFrame([], "term string, id long")
    else:
        shift = spark.createDataFrame(offsets, "_part int, _shift long")
        made = ordered.join(F.broadcast(shift), "_part").select("term", (F.col("_row") + F.col("_shift")).alias("id"))
    return made if known is None else known.select("term", "id").unionByName(made)


def save(dictionary: DataFrame, path: str) -> None:
    """Writes a dictionary, or what one doesn't have yet beside what is there."""
    dictionary.select("term", "id").write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, id long").parquet(path)


def extend(spark: SparkSession, path: str, quads: DataFrame) -> DataFrame:
    """Adds the terms of quads that a stored dictionary doesn't have; ids that are given stay. One writer
    at a time."""
    known = load(spark, path)
    save(build(quads, known).join(known.select("id"), "id", "left_anti"), path)
    return load(spark, path)


def encode(quads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(ts_ms, s, p, o, g) as ids; a term without an id gives NULL."""
    out = quads.select("ts_ms", *POSITIONS)
    for c in POSITIONS:
        out = out.join(dictionary.select(F.col("term").alias(c), F.col("id").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return out.select("ts_ms", *POSITIONS)


def decode(ids: DataFrame, dictionary: DataFrame, strict: bool = False) -> DataFrame:
    """Terms of ids; an unknown id is UNKNOWN, or with strict an error when the row is read."""
    out = ids.select("ts_ms", *POSITIONS)
    for c in POSITIONS:
        out = out.join(dictionary.select(F.col("id").alias(c), F.col("term").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
        missing = F.raise_error(F.lit("an id isn't in the dictionary")).cast("string") if strict else F.lit(UNKNOWN)
        out = out.withColumn(c, F.coalesce(c, missing))
    return out.select("ts_ms", *POSITIONS)


def size(dictionary: DataFrame) -> int:
    return dictionary.count()


def encode_record(ts_ms: int, s: int, p: int, o: int, g: int) -> bytes:
    return RECORD.pack(ts_ms, s, p, o, g)


def decode_record(raw: bytes) -> tuple[int, int, int, int, int]:
    if len(raw) != RECORD.size:
        raise StorageError(f"a record has {RECORD.size} bytes, not {len(raw)}")
    return RECORD.unpack(raw)


class Dictionary:
    """A small dictionary on the driver: ids by first sight, shared by all positions."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.terms: list[str] = []

    def encode(self, term: str) -> int:
        if term not in self.ids:
            self.ids[term] = len(self.terms)
            self.terms.append(term)
        return self.ids[term]

    def decode(self, k: int) -> str | None:
        return self.terms[k] if 0 <= k < len(self.terms) else None

    def save(self, path: str) -> None:
        """Writes the terms by id, one JSON string a line."""
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(json.dumps(t) + "\n" for t in self.terms)

    @classmethod
    def load(cls, path: str) -> Dictionary:
        out = cls()
        with open(path, encoding="utf-8") as f:
            for line in f:
                out.encode(json.loads(line))
        return out

    def __len__(self) -> int:
        return len(self.terms)

    def shown(self, s: int, p: int, o: int, g: int, ts_ms: int) -> str:
        """A quad of ids as text."""
        names = [self.decode(k) or UNKNOWN for k in (s, p, o, g)]
        return f"<<{names[0]}, {names[1]}, {names[2]}>> {names[3]} @ {ts_ms}"
