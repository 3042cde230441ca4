"""A session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "arbora", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow batches of 4 MB; the cluster's own settings otherwise."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
    return SparkSession.builder.appName(name).config(map=base | settings).getOrCreate()
