"""What the operators share: table access, the shared work folder, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import discard, materialize, scratch, workspace

__all__ = ["attach_group_min", "discard", "filesystem", "materialize", "prepare", "read_table", "scratch", "workspace"]

PACKAGE = Path(__file__).resolve().parent.parent
#: Rows and bytes of one Arrow batch: documents may be long, and a Python worker holds a batch or two.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Makes this package importable on executors and keeps Arrow batches small, by the session's settings
    for them, which are only ever lowered. Safe to call again and again."""
    sc = spark.sparkContext
    if getattr(sc, "_quadtide_shipped", None) is None:
        path = os.path.join(tempfile.mkdtemp(prefix="quadtide-"), "quadtide.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
        sc.addPyFile(path)
        sc._quadtide_shipped = path
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def attach_group_min(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds the least `value` among rows with equal keys. df must be cheap to read more than once.

    Keys that hold over 1/256 of the rows are at most 256, so their minima are broadcast; only the
    rows of other keys are shuffled, and no task gets a hot key. Null keys get null.
    """
    total = df.count()
    groups = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("_n"))
    least = max(total // 256, 1)
    hot = groups.where(F.col("_n") > least).drop("_n")
    cold = groups.where((F.col("_n") <= least) & (F.col("_n") > 1)).drop("_n")
    served = df.join(F.broadcast(hot), keys, "left").withColumnRenamed(out, "_hot")
    easy = served.where(F.col("_hot").isNotNull()).withColumnRenamed("_hot", out)
    rest = served.where(F.col("_hot").isNull()).drop("_hot").join(cold, keys, "left")
    known = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    rest = rest.withColumn(out, F.coalesce(out, F.when(known, F.col(value))))
    return easy.unionByName(rest)


def filesystem(uri: str):
    """(file system, path) of a shared folder for Python workers."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)
