"""A session with the settings that the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, ANSI mode, UTC. master and partitions: left to the cluster unless given."""
    b = SparkSession.builder.appName("lodeworks").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()
