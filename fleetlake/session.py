"""Session settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(name: str = "fleetlake", **more: str) -> SparkSession:
    """A session with the library's settings; ``more`` adds or overrides."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()
