"""Declared schemas and readers and writers for the tables of a scale directory."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: The declared columns of each table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table with its declared schema; nothing is inferred from the files."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views for SQL text."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_json(spark: SparkSession, path: str, schema: str, whole_files: bool = True) -> DataFrame:
    """Structured datasets kept as JSON: a declared schema, and drift is an error."""
    return spark.read.schema(schema).option("multiLine", whole_files).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Delimited text with a declared schema; a row that does not fit is an error."""
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_orc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).orc(path)


def read_raw(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as they are (path, time, length, content), for extraction by a later step."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_orc(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").orc(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that all executors share; it is deleted at the end of the process.

    That is ``spark.checkpoint.dir``; only a local session may do without it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='larkspan-')}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


_MADE: list[tuple[SparkSession, str]] = []


@atexit.register
def clear() -> None:
    """Delete the folders that this process has named, by their path where the session is gone."""
    while _MADE:
        spark, path = _MADE.pop()
        if spark.sparkContext._jsc is not None:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        elif path.startswith("file:"):
            shutil.rmtree(urlparse(path).path, ignore_errors=True)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
