"""Window functions and event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators import ranks
from larkspan.plans.registry import query
from larkspan.sources import table

_USER = "PARTITION BY user_id ORDER BY ts, event_id"


def _user() -> Window:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("SELECT event_type, event_id, value, rk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rk FROM events) WHERE rk <= 3")
def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").select("event_type", "event_id", "value", F.row_number().over(order).alias("rk")).where("rk <= 3")


@query(f"SELECT event_id, user_id, CAST(date_diff('second', lag(ts) OVER ({_USER}), ts) AS BIGINT) AS gap FROM events")
def lag_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("ts").over(_user())
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.timestamp_diff("SECOND", F.date_trunc("second", before), F.date_trunc("second", "ts")).alias("gap"))


@query(f"SELECT event_id, user_id, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER ({_USER} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM events")
def running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("value").cast("decimal(18,4)")).over(_user().rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("event_id", "user_id", total.cast("double").alias("total"))


@query(f"SELECT event_id, user_id, round(CAST(sum(CAST(value AS DECIMAL(18,4))) OVER ({_USER} ROWS 2 PRECEDING) AS DOUBLE) / count(*) OVER ({_USER} ROWS 2 PRECEDING), 4) AS mean3 FROM events")
def moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _user().rowsBetween(-2, 0)
    mean = F.sum(F.col("value").cast("decimal(18,4)")).over(frame).cast("double") / F.count("*").over(frame)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(mean, 4).alias("mean3"))


_BY_NATION = "PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey"


@query(f"SELECT c_custkey, CAST(ntile(4) OVER ({_BY_NATION}) AS INTEGER) AS quarter FROM customer")
def ntile_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "c_custkey")
    return rows.select("c_custkey", ranks.tile(4).alias("quarter"))


@query(f"SELECT c_custkey, round(percent_rank() OVER ({_BY_NATION}), 6) AS share FROM customer")
def percent_rank_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_acctbal", "c_custkey")
    # The customer's key is part of the order, so no two share a rank.
    return rows.select("c_custkey", F.round(ranks.percent("row_no"), 6).alias("share"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY start""")
def sliding_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "24 hours", "12 hours")).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query(f"""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER ({_USER} ROWS UNBOUNDED PRECEDING) AS s FROM
  (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER ({_USER}) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("all"))
    return rows.select("conv_id", "turns", F.array_join("all.role", ">").alias("roles"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(rank() OVER (ORDER BY l_extendedprice) AS BIGINT) AS place, CAST(ntile(100) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS hundredth FROM lineitem")
def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and hundredths in the whole table: no task sees more than a cell of the prices."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"))
    rows = ranks.ranked(lines, [], "l_extendedprice", "id")
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("rank").alias("place"), ranks.tile(100).alias("hundredth"))
