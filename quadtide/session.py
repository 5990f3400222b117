"""Session factory with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC makes event time the same on every machine; AQE sizes shuffles and splits skewed joins at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(app: str = "quadtide", **settings: str) -> SparkSession:
    """The active session, or a new one; settings override the defaults (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
