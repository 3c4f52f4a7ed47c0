"""Joins of two streams within an interval of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, seconds: int, late: str, outer: bool = False) -> DataFrame:
    """Rows of ``left`` with those of ``right`` of the same key from their time to ``seconds`` later.

    Both sides have a watermark, and the interval bounds how far one can be behind the other,
    so a row leaves the state once no partner can come.  With ``outer``, a row of ``left``
    that had none is returned then, with nulls.
    """
    left = left.withWatermark(left_at, late)
    right = right.withColumnRenamed(key, "right_key").withWatermark(right_at, late)
    limit = F.col(left_at) + F.expr(f"INTERVAL {int(seconds)} SECONDS")  # a literal: the state's bound is taken from it
    on = (F.col(key) == F.col("right_key")) & (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= limit)
    return left.join(right, on, "left_outer" if outer else "inner").drop("right_key")
