"""Sinks for ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Upsert:
    """Keeps the last row of each key in a partitioned parquet table.

    Keys are dealt to ``buckets`` by their hash.  A batch is merged with the buckets it touches
    and these alone are written again, each swapped in when the write has ended.  The last row
    is that with the greatest ``order``, ties by the other columns, whatever batch it came in:
    merging a batch a second time, whole or after a crash in the middle, changes nothing, and
    so does a batch that comes after a newer one.  Rows with a null key are left out.
    """

    BUCKET = "__bucket"

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], buckets: int = 32):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path, schema, keys, order, buckets

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {self.BUCKET} int").parquet(self.path)

    def _exists(self) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def table(self) -> DataFrame:
        """The rows as they stand."""
        return self._stored().drop(self.BUCKET)

    def last(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in self.keys]
        rank = F.struct(*self.order, *(c for c in others if c not in self.order))
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), rank).alias("r")).select(*self.keys, "r.*")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        columns = self.spark.createDataFrame([], self.schema).columns
        for k in self.keys:
            batch = batch.where(F.col(k).isNotNull())
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = self.last(batch.select(*columns)).withColumn(self.BUCKET, bucket).persist()
        try:
            touched = [r[0] for r in new.select(self.BUCKET).distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            rows = new.select(*columns)
            if self._exists():
                rows = rows.unionByName(self._stored().where(F.col(self.BUCKET).isin(touched)).select(*columns))
            merged = self.last(rows).select(*columns, bucket.alias(self.BUCKET))
            merged.repartition(len(touched), self.BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.BUCKET).parquet(self.path)
        finally:
            new.unpersist()


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give all that is there to ``sink``, batch by batch, and stop."""
    stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
