"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed words and word pairs are counted: the raw corpus
(every document) and the trusted target (every document labelled good).  A
document's score is the mean over its n-grams of log(target / raw).  It is kept
if the score reaches a threshold that is a function of the trusted documents
alone: their median less ``spread`` times their median absolute deviation, both
exact, so the verdict needs no random draw and treats every document alike.

Defined cases: null and empty texts have no words and fail the base rules; without
trusted documents the ratio is 0 for all and only base rules decide; rows with
one doc_id are judged by their own text; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .docstats import Stats
from .keys import sent
from .scratch import Scratch

BUCKETS = 1 << 15
SMOOTH = 1.0
SPREAD = 16.0
#: Cells that a pass over the values of a median cuts them into, and values that are fetched as they are.
CELLS, FEW = 1_024, 10_000


def _buckets(stats: Stats) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each word and each pair of words."""
    pairs, doc = stats.grams(2)
    half = np.uint64(BUCKETS // 2 - 1)
    one = (A.mix(stats.hashes, 21) & half).astype(np.int64)
    two = (pairs & half).astype(np.int64) + BUCKETS // 2
    return np.r_[one, two], np.r_[stats.doc, doc]


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for chunk in A.chunks(batches):
        bucket, doc = _buckets(Stats(chunk))
        trusted = np.asarray(chunk.column("trusted").to_numpy(zero_copy_only=False), bool)
        raw += np.bincount(bucket, minlength=BUCKETS)
        target += np.bincount(bucket[trusted[doc]], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame) -> np.ndarray:
    """log(target / raw) by bucket, from columns text and trusted of all documents."""
    found = docs.select("text", "trusted").mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    rows = found.toArrow()  # at most BUCKETS rows
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    at = np.asarray(rows["bucket"], np.int64)
    raw[at] += np.asarray(rows["raw"], np.float64)
    target[at] += np.asarray(rows["target"], np.float64)
    if target.sum() <= SMOOTH * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


_SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"


def scored(docs: DataFrame, labels: DataFrame, work: Scratch | None = None) -> DataFrame:
    """Every document with its base counts, mean log-likelihood ratio, and whether it is trusted."""
    spark = docs.sparkSession
    work = work or Scratch(spark, "rules")
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__good")).distinct()
    good = sent(*work.counted(good, "good"))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(good, F.col("doc_id") == F.col("__good"), "left").withColumn("trusted", F.col("__good").isNotNull()).drop("__good")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = spark.sparkContext.broadcast(log_ratios(marked(rows)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches):
            stats = Stats(chunk)
            bucket, doc = _buckets(stats)
            total = np.bincount(doc, ratios.value[bucket], len(chunk))
            llr = total / np.maximum(np.bincount(doc, minlength=len(chunk)), 1)
            _, dup = stats.n_lines_and_repeats()
            counts = [stats.n_words, stats.word_chars(), stats.n_symbols(), dup, stats.n_repeat_words()]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in counts], pa.array(llr)], [c.split()[0] for c in _SCORED.split(", ")])

    return marked(rows.mapInArrow(run, _SCORED))


def median(rows: DataFrame, value: Column, cells: int = CELLS, few: int = FEW) -> float | None:
    """The exact median of a column, None if there is none.

    Each pass counts the rows of ``cells`` cells between the bounds and goes on with the cell
    that holds the middle, so no task and no driver has more than ``few`` values.
    """
    x = rows.select(value.cast("double").alias("x")).where("x IS NOT NULL")
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).head()
    if not n:
        return None
    before, mine, middle = 0, n, (n - 1) // 2
    while low < high and mine > few:
        width = max((high - low) / cells, 5e-324)
        cell = F.least(F.floor((F.col("x") - low) / width), F.lit(cells - 1))
        counts = x.where(F.col("x").between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("cell").collect()  # a row a cell
        for r in counts:
            low, high, mine = r["lo"], r["hi"], r["n"]
            if middle < before + mine:
                break
            before += mine
    if low < high:
        low = [r["x"] for r in x.where(F.col("x").between(low, high)).sort("x").collect()][middle - before]
    upto, above = x.agg(F.count_if(F.col("x") <= low), F.min(F.when(F.col("x") > low, F.col("x")))).head()
    return low if n % 2 or upto > n // 2 else (low + above) / 2


def verdicts(docs: DataFrame, labels: DataFrame, spread: float = SPREAD) -> DataFrame:
    """Base counts, llr, threshold, base_failed and kept of every document."""
    work = Scratch(docs.sparkSession, "rules")
    rows = work.save(scored(docs, labels, work), "scored")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    known = rows.where(F.col("trusted") & ~failed)
    middle = median(known, F.col("llr"))
    if middle is None:
        threshold = float("-inf")
    else:
        threshold = middle - spread * max(median(known, F.abs(F.col("llr") - middle)), 1e-3)
    out = rows.withColumn("base_failed", failed).withColumn("threshold", F.lit(threshold))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.col("threshold")))
