"""Queries op8 and op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, near_dedup
from .keys import LAST


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_dedup.classes(docs)
    doc_id = F.when(F.col("ord") < LAST, F.col("ord"))
    return out.select(doc_id.alias("doc_id"), F.when(F.col("class_id") < LAST, F.col("class_id")).alias("class_id"), F.col("texts").alias("class_texts"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = line_dedup.dedup(docs.select("doc_id", "text"), n_lines="n_lines", n_kept="n_kept")
    count = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_lines", "n_kept")]
    return out.select("doc_id", *count, F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
