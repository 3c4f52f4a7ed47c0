"""Streams over the events, drained, with the SQL that their result equals.

The events come in files of reordered rows: each is up to LATE late.  A result is what the
final watermark has decided, which the SQL works out from the latest event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan import sources, streaming
from larkspan.plans.registry import query
from larkspan.sources import table
from larkspan.streaming import joins, sinks, state

#: Milliseconds that a row can be late; no two events are that far apart to the millisecond.
LATE = 599_999
#: Files the events are dealt to.
FILES = 6
#: Milliseconds within which one step follows another.
WITHIN = 3_600_000


def reordered(events: DataFrame, path: str, files: int = FILES, late: int = LATE) -> None:
    """Write the events to ``files`` files one after the other, each row up to ``late`` ms after its time."""
    at = F.unix_millis(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(late))
    low, high = events.agg(F.min(at), F.max(at)).head()
    if low is None:
        events.coalesce(1).write.parquet(path)
        return
    part = F.least(F.floor((at - low) * files / (high - low + 1)), F.lit(files - 1))
    for i in range(files):
        # Filtered by all tasks; only the rows of the file go to its one writer.
        events.where(part == i).repartition(1).write.mode("append").parquet(path)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str]:
    root = sources.shared_path(spark, name)
    reordered(table(spark, sf_dir, "events"), f"{root}/in")
    return streaming.events(spark, f"{root}/in"), root


_STEPS = f"""WITH s AS (
  SELECT user_id, event_id, event_type, epoch_ms(ts) AS ms FROM events WHERE event_type IN ('view', 'purchase')
), n AS (
  SELECT *, lead(ms) OVER w AS next_ms, lead(event_id) OVER w AS next_id, lead(event_type) OVER w AS next_type FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)
), m AS (SELECT max(epoch_ms(ts)) - {LATE} AS mark FROM events WHERE event_type IN ('view', 'purchase'))
SELECT user_id, event_id AS first_id, CASE WHEN next_ms <= ms + {WITHIN} THEN next_id END AS next_id,
       CASE WHEN next_ms <= ms + {WITHIN} THEN CASE next_type WHEN 'purchase' THEN 'reached' ELSE 'repeated' END ELSE 'expired' END AS outcome
FROM n, m WHERE event_type = 'view' AND (next_ms <= mark AND next_ms <= ms + {WITHIN} OR ms + {WITHIN} < mark AND coalesce(next_ms > ms + {WITHIN}, TRUE))"""


@query(_STEPS)
def stream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of each view of a user: keyed state with timers."""
    stream, root = _stream(spark, sf_dir, "steps")
    found = state.outcomes(stream, "user_id", "ts", "event_id", "event_type", "view", "purchase", WITHIN, f"{LATE} milliseconds")
    with state.on_disk(spark):
        streaming.drain(found, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(state.OUTCOME).parquet(f"{root}/out").withColumnRenamed("key", "user_id")


_PAIRS = f"""WITH v AS (SELECT user_id, event_id AS view_id, ts AS view_at FROM events WHERE event_type = 'view'),
p AS (SELECT user_id, event_id AS purchase_id, ts AS purchase_at FROM events WHERE event_type = 'purchase'),
m AS (SELECT least(max(epoch_ms(ts)) FILTER (event_type = 'view'), max(epoch_ms(ts)) FILTER (event_type = 'purchase')) - {LATE} AS mark FROM events)
SELECT v.user_id, view_id, purchase_id FROM v JOIN p ON v.user_id = p.user_id AND purchase_at >= view_at AND purchase_at <= view_at + INTERVAL {WITHIN // 1000} SECOND
UNION ALL
SELECT user_id, view_id, NULL FROM v, m WHERE epoch_ms(view_at) + {WITHIN} < mark
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = v.user_id AND purchase_at >= view_at AND purchase_at <= view_at + INTERVAL {WITHIN // 1000} SECOND)"""


@query(_PAIRS)
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of the hour after, two streams; those without any when that is certain."""
    stream, root = _stream(spark, sf_dir, "pairs")
    again = streaming.events(spark, f"{root}/in")
    views = stream.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_at"))
    purchases = again.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_at"))
    found = joins.within(views, purchases, "user_id", "view_at", "purchase_at", WITHIN // 1000, f"{LATE} milliseconds", outer=True)
    with state.on_disk(spark):
        streaming.drain(found.select("user_id", "view_id", "purchase_id"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema("user_id long, view_id long, purchase_id long").parquet(f"{root}/out")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, kept up to date batch by batch."""
    stream, root = _stream(spark, sf_dir, "upsert")
    sink = sinks.Upsert(spark, f"{root}/table", "user_id long, event_type string, event_id long, ts timestamp", ["user_id", "event_type"], ["ts", "event_id"], buckets=8)
    sinks.each_batch(stream, sink, f"{root}/checkpoint")
    return sink.table().withColumn("ts", F.col("ts").cast("timestamp_ntz"))
