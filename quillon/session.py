"""Spark session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "quillon", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's settings win."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
