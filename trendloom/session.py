"""Session factory and the few settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "trendloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; on a cluster the launcher's own settings win."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions or cpus))
    return builder.getOrCreate()
