"""The quad log: a Parquet dataset partitioned by time bucket, with an in-memory write buffer.

Partition pruning and row-group statistics do what segment directories and sparse indexes do
elsewhere: a time range touches only its buckets and, in them, only the row groups that overlap.
Ranges are complete and closed at both ends, whatever the order in which quads came.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError
from ..model import QUAD, typed
from ..operators.windows import time_range

#: Buckets that a scan asks for one by one.
FEW_BUCKETS = 64
COLUMNS = "ts_ms long, s string, p string, o string, g string"


@dataclass(frozen=True)
class LogConfig:
    """A flush happens at max_events buffered quads, max_bytes (estimated) or max_age_s, whichever is
    first; buckets are bucket_ms long; row groups have about row_group_bytes."""

    max_events: int = 100_000
    max_bytes: int = 10 << 20
    max_age_s: float = 60.0
    bucket_ms: int = 3_600_000
    poll_s: float = 0.1
    row_group_bytes: int = 32 << 20
    file_bytes: int = 256 << 20


class QuadLog:
    """An append-only log of quads at a path. Single quads are buffered on the driver; bulk data is
    appended from DataFrames without passing through it."""

    def __init__(self, spark: SparkSession, path: str, config: LogConfig = LogConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self._buffer: list[tuple[int, str, str, str, str]] = []
        #: Held while files change; readers wait for a flush, writers only for the buffer's lock.
        self._files = threading.RLock()
        self._bytes, self._oldest = 0, 0.0
        self._lock = threading.RLock()
        self._failure: Exception | None = None
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    # -- writing
    def healthy(self) -> None:
        """Raises the failure of a background flush; it stays until the log is opened again."""
        if self._failure is not None:
            raise StorageError(f"a background flush failed: {self._failure}") from self._failure

    def write(self, ts_ms: int, s: str, p: str, o: str, g: str = "") -> None:
        self.write_all([(ts_ms, s, p, o, g)])

    def write_all(self, rows: Iterable[tuple[int, str, str, str, str]]) -> None:
        self.healthy()
        full = False
        with self._lock:
            for r in rows:
                if not self._buffer:
                    self._oldest = time.monotonic()
                self._buffer.append(tuple(r))
                self._bytes += 24 + sum(len(x) for x in r[1:])
            full = len(self._buffer) >= self.config.max_events or self._bytes >= self.config.max_bytes
        if full and self._thread is None:
            self.flush()

    def append(self, quads: DataFrame, clustered: bool = False) -> int:
        """Appends quads in bulk, sorted by time inside of buckets, and tells how many. clustered: each partition holds a
        short range of times already, as streams and time-ordered files do, so nothing is shuffled."""
        self.healthy()
        bucket = F.floor(F.col("ts_ms") / self.config.bucket_ms).cast("long")
        rows = quads if "o_kind" in quads.columns else typed(quads)
        rows = rows.select(*QUAD.names).withColumn("bucket", bucket)
        if not clustered:  # many tasks may write one bucket: a hot bucket isn't one task's
            rows = rows.repartitionByRange(F.col("bucket"), F.col("ts_ms"))
        counted = Observation()
        rows = rows.sortWithinPartitions("bucket", "ts_ms").observe(counted, F.count(F.lit(1)).alias("n"))
        rows.write.mode("append").option("parquet.block.size", self.config.row_group_bytes).partitionBy("bucket").parquet(self.path)
        return counted.get["n"]

    def flush(self) -> int:
        """Writes the buffer; the number of quads. After a failure they are in the buffer again, in front."""
        with self._files:
            with self._lock:
                rows, self._buffer, self._bytes = self._buffer, [], 0
            if not rows:
                return 0
            try:
                self.append(self.spark.createDataFrame(rows, COLUMNS).coalesce(1), clustered=True)
            except Exception as e:
                with self._lock:
                    self._buffer = rows + self._buffer
                    self._bytes = sum(24 + sum(len(x) for x in r[1:]) for r in self._buffer)
                raise StorageError(f"can't write to {self.path}: {e}") from e
            return len(rows)

    def compact(self, files: int = 1, start_ms: int | None = None, end_ms: int | None = None) -> int:
        """Merges the files of each bucket (of a range of times) that has more than `files`; the number of
        buckets. One writer at a time; no quad is lost if it breaks off: a merged bucket stands under
        `_merged` until it is whole, then the old files go, and the next call or reader finishes that."""
        self.healthy()
        with self._files:
            self._finish()
            w, done = self.config.bucket_ms, 0
            for bucket in self._buckets(None if start_ms is None else start_ms // w, None if end_ms is None else end_ms // w):
                fs, path = self._at(f"bucket={bucket}")
                old = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")]
                if len(old) <= files:
                    continue
                size = sum(fs.getFileStatus(f).getLen() for f in old)
                merged = self.spark.read.schema(self._schema()).parquet(*(str(f) for f in old)).repartitionByRange(max(1, size // self.config.file_bytes), "ts_ms").sortWithinPartitions("ts_ms")
                staged = f"{self.path}/_merged/bucket={bucket}"
                merged.write.mode("overwrite").option("parquet.block.size", self.config.row_group_bytes).parquet(staged)
                out = fs.create(self._at(f"_merged/bucket={bucket}/_old")[1], True)  # from here on the old files are to go
                out.write("\n".join(f.getName() for f in old).encode())
                out.close()
                self._finish()
                done += 1
            return done

    def _finish(self) -> None:
        """Swaps merged buckets in whose list of old files is there, and drops those without."""
        fs, root = self._at("_merged")
        if not fs.exists(root):
            return
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            listed = self._at(f"_merged/{name}/_old")[1]
            if fs.exists(listed):
                stream = fs.open(listed)
                for old in bytes(stream.readAllBytes()).decode().split("\n"):
                    fs.delete(self._at(f"{name}/{old}")[1], False)
                stream.close()
                for part in fs.listStatus(f.getPath()):
                    if part.getPath().getName().startswith("part-"):
                        fs.rename(part.getPath(), self._at(f"{name}/{part.getPath().getName()}")[1])
            fs.delete(f.getPath(), True)
        fs.delete(root, True)

    def start_background(self) -> None:
        """Flushes in a thread when a limit is reached."""
        if self._thread is not None:
            return

        def loop() -> None:
            while not self._stop.wait(self.config.poll_s):
                with self._lock:
                    due = self._buffer and (len(self._buffer) >= self.config.max_events or self._bytes >= self.config.max_bytes or time.monotonic() - self._oldest >= self.config.max_age_s)
                if due:
                    try:
                        self.flush()
                    except Exception as e:
                        self._failure = e
                        return

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def close(self) -> None:
        """Stops the background thread and writes what is left."""
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
            self._thread = None
        self.healthy()
        self.flush()

    # -- reading
    def _at(self, name: str = ""):
        """(file system, path) of something in the log's folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    @staticmethod
    def _schema() -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in QUAD)

    def _buckets(self, low: int | None = None, high: int | None = None) -> list[int]:
        """The buckets that are there, in a range: a few are asked for one by one, else the folder is listed
        once, without its files."""
        fs, root = self._at()
        if low is not None and high is not None and high - low < FEW_BUCKETS:
            return [b for b in range(low, high + 1) if fs.exists(self._at(f"bucket={b}")[1])]
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        found = sorted(int(n[7:]) for n in names if n.startswith("bucket="))
        return [b for b in found if (low is None or b >= low) and (high is None or b <= high)]

    def _stored(self, low: int | None = None, high: int | None = None) -> DataFrame | None:
        """The quads of a range of buckets; only their folders are listed. None if there are none."""
        self._finish()
        found = self._buckets(low, high)
        if not found:
            return None
        reader = self.spark.read.schema(self._schema() + ", bucket long").option("basePath", self.path)
        return reader.parquet(self.path) if low is None and high is None else reader.parquet(*(f"{self.path}/bucket={b}" for b in found))

    def quads(self) -> DataFrame:
        """All quads, buffered ones too."""
        self.healthy()
        with self._files, self._lock:
            rows, stored = list(self._buffer), self._stored()
        held = typed(self.spark.createDataFrame(rows, COLUMNS)) if rows or stored is None else None
        if stored is None:
            return held
        return stored.drop("bucket") if held is None else stored.drop("bucket").unionByName(held)

    def scan(self, start_ms: int, end_ms: int, ordered: bool = False) -> DataFrame:
        """Quads with start_ms <= ts_ms <= end_ms; the bucket bounds prune partitions."""
        self.healthy()
        w = self.config.bucket_ms
        with self._files, self._lock:
            rows = [r for r in self._buffer if start_ms <= r[0] <= end_ms]
            stored = self._stored(start_ms // w, end_ms // w)
        parts = []
        if stored is not None:
            parts.append(time_range(stored.where(F.col("bucket").between(start_ms // w, end_ms // w)), start_ms, end_ms).drop("bucket"))
        if rows or not parts:
            parts.append(typed(self.spark.createDataFrame(rows, COLUMNS)))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out.orderBy("ts_ms") if ordered else out

    def at(self, ts_ms: int) -> DataFrame:
        return self.scan(ts_ms, ts_ms)

    def writer(self, stream: DataFrame, checkpoint: str, every: str = "10 seconds", clustered: bool = False):
        """A streaming query that appends a stream of quads to the log. clustered: as for append(); a broker's
        partitions that each span many buckets would write a file into each."""
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(lambda batch, _: self.append(batch, clustered=clustered)).start()
