"""Event-time aggregates over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.sources import SCHEMAS


def events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over parquet files of events; event time must be a timestamp with zone."""
    stream = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, length: str, late: str) -> DataFrame:
    counted = df.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def sliding(df: DataFrame, length: str, step: str, late: str) -> DataFrame:
    counted = df.withWatermark("ts", late).groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "n")


def sessions(df: DataFrame, gap: str, late: str) -> DataFrame:
    counted = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct(df: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once; state older than the watermark is dropped, so keys include the time."""
    return df.withWatermark("ts", late).dropDuplicates([*keys, "ts"])


def reached(df: DataFrame, table: DataFrame, key: str, score: str, cutoff: str) -> DataFrame:
    """The lookup on a stream: each row with the rows of its key whose cutoff it reaches.

    ``table`` is read anew in every batch; rows that reach nothing, and null cutoffs, give none.
    """
    return df.join(table, key).where(F.col(cutoff) <= F.col(score))


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; exactly once into parquet."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
