"""The session settings that the queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` uses _ for the dots of a key."""
    builder = SparkSession.builder.master(master).appName("larkspan")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"}
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
