"""A time index beside a table of quads in Parquet files: where in which file a time stands.

An entry is (file, row, ts_ms) of every N-th row of a file, and of its first and last one; with N = 1 the
index is dense. Files that are sorted by time, as a log's are, are then read only where a range can lie;
others are found by their entries as well, if the index is dense. Parquet's own statistics prune row
groups without any of this; an index saves opening the files at all, and serves tables that are not
partitioned by time.

Entries are read from the files by their row numbers, so building it is one pass without a shuffle of
quads, and the index is itself a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError
from . import dictionary as dictionaries

ENTRIES = "file string, row long, ts_ms long"


class TimeIndex:
    """An index at a path, over files of one schema with a column ts_ms."""

    def __init__(self, spark: SparkSession, path: str, schema: str, base: str | None = None):
        """schema: of the indexed files. base: the folder that they are partitioned below, if they are."""
        self.spark, self.path, self.schema, self.base = spark, path.rstrip("/"), schema, base

    @classmethod
    def build(cls, quads: DataFrame, path: str, every: int = 1000, base: str | None = None) -> TimeIndex:
        """Indexes every N-th row of each file of a DataFrame that was read from Parquet files."""
        if every < 1:
            raise StorageError("an index has an entry for every row at most")
        where = quads.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "ts_ms")
        ends = where.groupBy("file").agg(F.max("row").alias("last"))
        kept = where.join(ends, "file").where((F.col("row") % every == 0) | (F.col("row") == F.col("last"))) if every > 1 else where
        kept.select("file", "row", "ts_ms").write.mode("overwrite").parquet(path)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in quads.schema)
        return cls(quads.sparkSession, path, schema, base)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(self.path)

    def spans(self, start_ms: int, end_ms: int) -> DataFrame:
        """(file, low, high): the rows of each file between which times from start_ms to end_ms can stand."""
        by_file = self.entries().groupBy("file").agg(
            F.min("ts_ms").alias("least"), F.max("ts_ms").alias("most"),
            F.max(F.when(F.col("ts_ms") < start_ms, F.col("row"))).alias("before"), F.min(F.when(F.col("ts_ms") > end_ms, F.col("row"))).alias("after"), F.max("row").alias("last"))
        found = by_file.where((F.col("least") <= end_ms) & (F.col("most") >= start_ms))
        return found.select("file", F.coalesce("before", F.lit(0)).alias("low"), F.coalesce("after", "last").alias("high"))

    def query(self, start_ms: int, end_ms: int, dictionary: DataFrame | None = None) -> DataFrame:
        """The quads with start_ms <= ts_ms <= end_ms, only the files opened that have some; none if start_ms
        is over end_ms. dictionary: the files hold ids, which are given as terms."""
        files = [r["file"] for r in self.spans(start_ms, end_ms).select("file").collect()] if start_ms <= end_ms else []
        if not files:
            out = self.spark.createDataFrame([], self.schema)
        else:
            reader = self.spark.read.schema(self.schema)
            reader = reader if self.base is None else reader.option("basePath", self.base)
            out = reader.parquet(*files).where(F.col("ts_ms").between(start_ms, end_ms))
        return out if dictionary is None else dictionaries.decode(out, dictionary)


__all__ = ["TimeIndex"]
