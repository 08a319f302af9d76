"""A Spark session with the settings that the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tideline", **conf: str) -> SparkSession:
    """UTC, ANSI mode, adaptive execution with skew handling; anything else by keyword (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
