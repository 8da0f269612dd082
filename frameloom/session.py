"""Session with the settings that the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "frameloom", **extra: str) -> SparkSession:
    """Adaptive execution, skew handling and Arrow on; times in UTC."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    return SparkSession.builder.appName(app).config(map=conf | extra).getOrCreate()
