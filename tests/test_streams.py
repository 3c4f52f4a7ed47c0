"""Streams with state, joins of streams and the upsert sink: equal to a batch, after restarts too."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import pandas as pd

from larkspan import streaming
from larkspan.plans import streams
from larkspan.streaming import joins, sinks, state

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def put(spark, path, rows):
    """One file of (event_id, minutes, user, type)."""
    data = [(i, None if m is None else BASE + dt.timedelta(minutes=m), u, k, 1.0, "{}") for i, m, u, k in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def outcomes(spark, tmp_path, within=60):
    found = state.outcomes(streaming.events(spark, str(tmp_path / "in")), "user_id", "ts", "event_id", "event_type", "view", "purchase", within * 60_000, "10 minutes")
    with state.on_disk(spark):
        streaming.drain(found, str(tmp_path / "out"), str(tmp_path / "cp"))
    return {(r["key"], r["first_id"]): (r["next_id"], r["outcome"]) for r in spark.read.schema(state.OUTCOME).parquet(str(tmp_path / "out")).collect()}


def test_steps_of_reordered_files_and_a_restart(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, 5, 1, "view"), (2, 3, 1, "view"), (3, 8, 1, "click"), (4, 9, 2, "view"), (None, 4, 1, "view"), (90, None, 1, "view"), (91, 4, None, "view")])
    assert outcomes(spark, tmp_path) == {}
    put(spark, tmp_path / "in", [(5, 4, 1, "purchase"), (6, 20, 1, "purchase"), (7, 30, 3, "view")])
    # The watermark stands at 20: view 2 was followed by purchase 5, which came a file later, view 1 by purchase 6.
    assert outcomes(spark, tmp_path) == {(1, 2): (5, "reached"), (1, 1): (6, "reached")}
    put(spark, tmp_path / "in", [(8, 10, 3, "purchase"), (9, 85, 3, "view"), (10, 95, 3, "view"), (11, 95, 4, "purchase")])
    # Event 8 is too late; view 4 has expired, view 7 is followed by view 9 within the hour.
    want = {(1, 2): (5, "reached"), (1, 1): (6, "reached"), (2, 4): (None, "expired"), (3, 7): (9, "repeated")}
    assert outcomes(spark, tmp_path) == want
    assert outcomes(spark, tmp_path) == want  # nothing new, nothing twice
    put(spark, tmp_path / "in", [(12, 1000, 9, "purchase")])
    assert outcomes(spark, tmp_path) == want | {(3, 9): (10, "repeated"), (3, 10): (None, "expired")}


def test_steps_equal_a_walk_over_random_events(spark, tmp_path):
    r = random.Random(11)
    events = [(i, r.uniform(0, 3000), r.randrange(6), r.choice(["view", "purchase", "click"])) for i in range(600)]
    arrival = sorted(events, key=lambda e: e[1] + r.uniform(0, 9.9))
    for k in range(4):
        put(spark, tmp_path / "in", arrival[150 * k : 150 * k + 150])
    put(spark, tmp_path / "in", [(9999, 9000, 99, "purchase")])
    want = {}
    for u in range(6):
        mine = sorted((m, i, k) for i, m, v, k in events if v == u and k != "click")
        for (m, i, k), (n, j, kind) in zip(mine, [*mine[1:], (float("inf"), None, "")], strict=True):
            if k == "view":
                near = int(n * 60000) <= int(m * 60000) + 3_600_000 if n < float("inf") else False
                want[u, i] = (j, "reached" if kind == "purchase" else "repeated") if near else (None, "expired")
    assert outcomes(spark, tmp_path) == want


def pairs(spark, tmp_path):
    stream, again = (streaming.events(spark, str(tmp_path / "in")) for _ in "ab")
    views = stream.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_at"))
    purchases = again.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_at"))
    found = joins.within(views, purchases, "user_id", "view_at", "purchase_at", 3600, "10 minutes", outer=True)
    with state.on_disk(spark):
        q = found.select("view_id", "purchase_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    held = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    return sorted(map(tuple, spark.read.schema("view_id long, purchase_id long").parquet(str(tmp_path / "out")).collect()), key=str), held


def test_streams_joined_within_an_hour(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, 0, 1, "view"), (2, 10, 2, "view"), (3, 5, 1, "purchase")])
    assert pairs(spark, tmp_path)[0] == [(1, 3)]
    put(spark, tmp_path / "in", [(4, 60, 1, "purchase"), (5, 61, 1, "purchase"), (6, 70, 3, "view"), (7, 9, None, "purchase")])
    assert pairs(spark, tmp_path)[0] == [(1, 3), (1, 4)]
    put(spark, tmp_path / "in", [(8, 200, 5, "view"), (9, 200, 6, "purchase")])
    put(spark, tmp_path / "in", [(10, 201, 5, "view"), (11, 201, 5, "purchase")])
    found, _ = pairs(spark, tmp_path)
    assert found == sorted([(1, 3), (1, 4), (2, None), (6, None), (8, 11), (10, 11)], key=str)


def test_state_of_a_join_is_bounded(spark, tmp_path):
    for k in range(12):
        put(spark, tmp_path / "in", [(1000 * k + i, 120 * k + i, i % 5, ("view", "purchase")[i % 2]) for i in range(100)])
    found, held = pairs(spark, tmp_path)
    assert len(found) > 1000 and 0 < max(held) <= 320  # of 1,200 rows


SCHEMA2 = "k long, v string, at long"


@pytest.fixture
def sink(spark, tmp_path):
    return sinks.Upsert(spark, str(tmp_path / "table"), SCHEMA2, ["k"], ["at"], buckets=4)


def stored(sink):
    return {r["k"]: (r["v"], r["at"]) for r in sink.table().collect()}


def test_last_row_of_a_key_wins_whatever_the_order(spark, sink, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(list(rows), SCHEMA2)

    sink(batch((1, "a", 1), (1, "b", 3), (2, "c", 1), (None, "x", 9)), 0)
    assert stored(sink) == {1: ("b", 3), 2: ("c", 1)}
    sink(batch((1, "late", 2), (3, "d", 1), (2, "e", 5)), 1)
    want = {1: ("b", 3), 2: ("e", 5), 3: ("d", 1)}
    assert stored(sink) == want
    for again in (1, 0):
        sink(batch((1, "late", 2), (3, "d", 1), (2, "e", 5)) if again else batch((1, "a", 1), (1, "b", 3), (2, "c", 1)), again)
        assert stored(sink) == want
    sink(batch(), 2)
    assert stored(sink) == want
    sink(batch((3, None, 7), (4, "t1", 1), (4, "t2", 1)), 3)
    assert stored(sink) == want | {3: (None, 7), 4: ("t2", 1)}


def test_only_touched_buckets_are_written(spark, sink, tmp_path):
    sink(spark.createDataFrame([(i, "a", 0) for i in range(200)], SCHEMA2), 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").glob("*/*.parquet")}
    sink(spark.createDataFrame([(7, "b", 1)], SCHEMA2), 1)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").glob("*/*.parquet")}
    assert len({p.parent for p in before.keys() - after.keys()}) == 1 and len(before.keys() & after.keys()) >= 3
    assert len(stored(sink)) == 200 and stored(sink)[7] == ("b", 1)


def test_a_batch_replayed_after_a_crash_changes_nothing(spark, sink, tmp_path):
    """The sink fails after its write, so the stream runs the same batch again."""
    spark.createDataFrame([(i % 10, f"v{i}", i) for i in range(40)], SCHEMA2).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA2).parquet(str(tmp_path / "in"))
    calls = []

    def failing(batch, batch_id):
        sink(batch, batch_id)
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        sinks.each_batch(stream, failing, str(tmp_path / "cp"))
    first = stored(sink)
    sinks.each_batch(stream, failing, str(tmp_path / "cp"))
    assert calls == [0, 0] and stored(sink) == first == {k: (f"v{30 + k}", 30 + k) for k in range(10)}


def test_reordered_files_are_late_by_no_more_than_stated(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, r.uniform(0, 300), 1, "view") for i in range(500)]
    put(spark, tmp_path / "events", rows)
    streams.reordered(spark.read.schema(SCHEMA).parquet(str(tmp_path / "events")), str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == streams.FILES
    seen, latest, mixed = 0, None, 0
    for f in files:
        times = [x["ts"] for x in spark.read.schema(SCHEMA).parquet(str(f)).collect()]
        if latest:
            assert all(t > latest - dt.timedelta(milliseconds=streams.LATE + 1) for t in times)
            mixed += sum(t < latest for t in times)
        latest, seen = max([*times, latest or BASE]), seen + len(times)
    assert seen == 500 and mixed
    streams.reordered(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert spark.read.schema(SCHEMA).parquet(str(tmp_path / "none")).count() == 0


def test_rows_of_a_key_are_stored_by_one_call():
    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *args: self if name.startswith("get") and args else calls.append(name)

        def exists(self):
            return False

    steps = state._Steps("view", "purchase", 60_000)
    steps.init(Store())
    frame = pd.DataFrame({"ms": range(1_000), "id": range(1_000), "kind": ["view"] * 1_000})
    list(steps.handleInputRows((1,), iter([frame]), None))
    assert len(calls) == 3  # the rows, the timer and its time


def test_keys_of_a_bucket_are_taken_at_once():
    """Calls to the store do not grow with the keys, and every key has its own open step."""
    calls, timers = [], set()

    class Value:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            calls.append("get")
            return self.rows[0] if self.single else iter(self.rows)

        def update(self, row):
            calls.append("update")
            self.rows = [row]

        def put(self, rows):
            calls.append("put")
            self.rows = list(rows)

        def appendList(self, rows):
            calls.append("append")
            self.rows += rows

        def clear(self):
            calls.append("clear")
            self.rows = []

    class Handle:
        registerTimer, deleteTimer = timers.add, timers.remove

        def getListState(self, *_):
            out = Value()
            out.single = False
            return out

        def getValueState(self, *_):
            out = Value()
            out.single = True
            return out

    class Times:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

        getExpiryTimeInMs = getCurrentWatermarkInMs

    steps = state._Steps("view", "purchase", 60)
    steps.init(Handle())
    n = 500
    found, kinds = {}, (["view"] * n, ["purchase" if k % 2 else "view" for k in range(n)])
    for turn, (at, kind) in enumerate(zip((100, 150), kinds, strict=True)):
        rows = pd.DataFrame({"key": range(n), "ms": [at] * n, "id": [1000 * turn + k for k in range(n)], "kind": kind})
        list(steps.handleInputRows((7,), iter([rows]), None))
        for frame in steps.handleExpiredTimer((7,), Times(at + 10), Times(min(timers))):
            found |= {(r.key, r.first_id): (r.next_id, r.outcome) for r in frame.itertuples()}
    assert found == {(k, k): (1000 + k, "reached" if k % 2 else "repeated") for k in range(n)}
    for frame in steps.handleExpiredTimer((7,), Times(211), Times(min(timers))):
        found |= {(r.key, r.first_id): (r.next_id, r.outcome) for r in frame.itertuples()}
    assert {k for k, v in found.items() if v[1] == "expired"} == {(k, 1000 + k) for k in range(0, n, 2)}
    assert len(calls) < 60 and not any(x.rows for x in (steps.ahead, steps.open))
