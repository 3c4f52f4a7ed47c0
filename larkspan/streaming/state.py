"""Keyed state with timers: what became of each first step of a key.

Rows are kept until the watermark has passed them and are then taken in event-time order, so
the outcome does not depend on the order in which files arrive.  Keys are dealt to a fixed
number of buckets.  State of a bucket is the rows ahead of the watermark, an open step of each
key that has one, and one timer; all go when nothing is pending.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTCOME = "key long, first_id long, next_id long, outcome string"


@contextmanager
def on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB and not on the heap."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


#: Groups that keys are dealt to; each has one state, whose rows are taken all at once.
BUCKETS = 256


def _packed(*columns) -> np.ndarray:
    """Rows (key, ms, id, is it a first step) of numbers."""
    return np.stack(np.broadcast_arrays(*columns), axis=1).astype("<i8")


def _unpacked(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<i8").reshape(-1, 4)


class _Steps(StatefulProcessor):
    def __init__(self, first: str, then: str, within: int):
        self.first, self.then, self.within = first, then, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Rows of many keys are one value: neither a row nor a key costs a call of its own to the store.
        self.ahead = handle.getListState("ahead", "rows binary")
        self.open = handle.getValueState("open", "rows binary")
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, at: int | None) -> None:
        """Have the one timer of the bucket at ``at``."""
        due = self.due.get()[0] if self.due.exists() else None
        if due == at:
            return
        if due is not None:
            self.handle.deleteTimer(due)
            self.due.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Rows without a key of their own are those of the group's.
        new = [_packed(frame.get("key", key[0]), frame["ms"], frame["id"], frame["kind"] == self.first) for frame in rows if len(frame)]
        if new:
            self.ahead.appendList([(x.tobytes(),) for x in new])
            least = min(int(x[:, 1].min()) for x in new)
            due = self.due.get()[0] if self.due.exists() else None
            self._wake(least if due is None else min(due, least))
        return iter(())

    def _decided(self, opened: np.ndarray, rows: np.ndarray, mark: int) -> tuple[pd.DataFrame, np.ndarray]:
        """The outcomes of open steps and ``rows``, all up to ``mark``, and the steps that are open then."""
        both = np.concatenate([opened, rows])
        turn = np.arange(len(both)) >= len(opened)
        both = both[np.lexsort((both[:, 2], both[:, 1], turn, both[:, 0]))]
        who, ms, ident, first = both.T
        follows = np.zeros(len(both), bool)
        follows[:-1] = who[1:] == who[:-1]
        nxt = np.minimum(np.arange(len(both)) + 1, max(len(both) - 1, 0))
        near = follows & (ms[nxt] <= ms + self.within)
        over = (first == 1) & (follows | (ms + self.within < mark))
        outcome = np.where(~near, "expired", np.where(first[nxt] == 1, "repeated", "reached"))
        next_id = pd.arrays.IntegerArray(ident[nxt[over]], ~near[over])
        found = pd.DataFrame({"key": who[over], "first_id": ident[over], "next_id": next_id, "outcome": outcome[over].astype(object)})
        return found, both[(first == 1) & ~over]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.due.exists() and self.due.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.due.clear()
        rows = _unpacked([x[0] for x in self.ahead.get()])
        # Of rows of a key that agree in time and id the last one counts.
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        last = np.ones(len(rows), bool)
        last[:-1] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        rows = rows[last]
        opened = _unpacked([self.open.get()[0]] if self.open.exists() else [])
        left = rows[rows[:, 1] > mark]
        if len(left):
            self.ahead.put([(left.tobytes(),)])
        else:
            self.ahead.clear()
        out, opened = self._decided(opened, rows[rows[:, 1] <= mark], mark)
        if len(opened):
            self.open.update((opened.tobytes(),))
        elif self.open.exists():
            self.open.clear()
        ends = [*left[:, 1], *(opened[:, 1] + self.within + 1)]
        self._wake(int(min(ends)) if ends else None)
        if len(out):
            yield out

    def close(self) -> None:
        pass


def outcomes(stream: DataFrame, key: str, at: str, ident: str, kind: str, first: str, then: str, within_ms: int, late: str) -> DataFrame:
    """For each row of kind ``first``: is the key's next row of kind ``first`` or ``then`` at most ``within_ms`` later.

    The outcome is ``reached`` (a ``then``), ``repeated`` (another ``first``) or ``expired``.
    Rows of one time go by their id.  Rows with a null in any of the columns are left out,
    as are those later than the watermark.
    """
    steps = stream.where(F.col(kind).isin(first, then)).withWatermark(at, late)
    steps = steps.select(F.col(key).cast("long").alias("key"), at, F.unix_millis(F.col(at)).alias("ms"), F.col(ident).cast("long").alias("id"), F.col(kind).alias("kind")).dropna()
    steps = steps.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return steps.groupBy("bucket").transformWithStateInPandas(_Steps(first, then, within_ms), OUTCOME, "Append", "EventTime")
