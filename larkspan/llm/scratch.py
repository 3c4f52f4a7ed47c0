"""Written intermediate tables in the folder all executors share.

A long job cuts its lineage by writing a table and reading it back, so a lost
executor costs the tasks it was running and not the whole chain.  The folder is
the one the cluster names in ``spark.checkpoint.dir``; only where that setting
is absent (unit tests, a laptop) is a local folder made up.

What a write shuffled is deleted when it ends, as the table is read in its place: a job of
many writes holds the shuffle files of one of them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of keys or links that a task writes.
TASK_ROWS = 25_000

_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LIVE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, set to a local one only if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # The setting cannot change in a running application; the context's folder can.
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='larkspan-')}")
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here delete their shuffle files at their end."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


class Scratch:
    """Tables of one run of one operator, under a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        _LIVE.append((spark, self.root))

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write ``df`` and return it as read back from the shared folder.

        ``rows``, if known, is the most it can have: a small table then has few files.
        """
        return self.counted(df, name, rows)[0]

    def counted(self, df: DataFrame, name: str, rows: int | None = None, where: Column | str = "true") -> tuple[DataFrame, int]:
        """``save``, and the number of rows where a condition holds, counted while writing."""
        path, seen = f"{self.root}/{name}", Observation()
        self.names.append(name)
        parts = df if rows is None else df.coalesce(rows // TASK_ROWS + 1)
        with _tidy(self.spark):
            parts.observe(seen, F.count_if(F.expr(where) if isinstance(where, str) else where).alias("n")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]

    def only(self, *names: str) -> None:
        """Delete all tables but ``names``, when nothing reads the others any more."""
        self.drop(*(set(self.names) - set(names)))

    def drop(self, *names: str) -> None:
        """Delete those of the tables ``names`` that there are, when nothing reads them any more."""
        for name in set(self.names) & set(names):
            _delete(self.spark, f"{self.root}/{name}")
        self.names = [x for x in self.names if x not in names]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def clear() -> None:
    """Delete what this process still has in the shared folder."""
    while _LIVE:
        spark, root = _LIVE.pop()
        if spark.sparkContext._jsc is not None:
            _delete(spark, root)
