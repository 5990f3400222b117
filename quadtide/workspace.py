"""Tables written to the folder that all executors share, to cut lineage and to reuse a result."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: How written tables reach a local folder. Hadoop's checksummed local files take a chmod process each, and
#: more for the checksum's file, where its native library is missing; each is a fork of a whole JVM.
LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def workspace(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without it, a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quadtide-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_late(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the interpreter ends."""
    path = f"{workspace(spark)}/quadtide/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove_late, spark, path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back; it survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.options(**LOCAL).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quadtide_path = path
    return out


def write_text(spark: SparkSession, folder: str, name: str, body: str) -> None:
    """A file of UTF-8 text, moved into place when it is whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hidden, final = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}") for x in (f"_{uuid.uuid4().hex}", name))
    fs = hidden.getFileSystem(conf)
    out = fs.create(hidden)
    out.write(body.encode())
    out.close()
    fs.rename(hidden, final)


def discard(df: DataFrame) -> None:
    """Removes a materialized table that no later plan reads."""
    remove(df.sparkSession, df._quadtide_path)
