"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once on the executors.  The model is
fitted on the driver from the statistics of at most ``max_rows`` labelled rows
(a documented bound; rows are picked by a hash of doc_id), in the manner of
histogram boosting: features are binned at quantiles and each level of a tree is
one histogram of gradients.  Trees are complete and flattened into three arrays,
so scoring is a few gathers per level for a whole batch.

Defined cases: null and empty texts have all-zero statistics and get a score;
labels that are null or of unknown documents are ignored; equal labels of one doc_id
are one label, and a doc_id with both labels teaches nothing; all documents of a
repeated doc_id have its label, and of more than 2 * ``max_rows`` such rows those with the
least hashes are learnt; if the labels hold one
class only, or none, every score is that class's smoothed share; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import docstats
from .scratch import Scratch

#: Labelled rows the model is fitted on, at most.
MAX_ROWS = 40_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 80, 4, 64, 0.15, 2.0, 1.0


class Trees:
    """Complete trees of one depth in flat arrays: split feature, cut and leaf value."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted trees for the log loss; deterministic for given rows."""
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    base, inner = float(np.log(share / (1 - share))), 2**DEPTH - 1
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**DEPTH)))
    if not 0 < y.sum() < n:
        return none
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    margin = np.full(n, base)
    out = ([], [], [])
    column = np.arange(width)[None, :]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**DEPTH)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width_nodes, first = 2**level, 2**level - 1
            at = (((node - first)[:, None] * width + column) * BINS + binned).ravel()
            shape = (width_nodes, width, BINS)
            gs = np.bincount(at, np.repeat(g, width), width_nodes * width * BINS).reshape(shape).cumsum(2)
            hs = np.bincount(at, np.repeat(h, width), width_nodes * width * BINS).reshape(shape).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + RIDGE) + (ga - gs) ** 2 / (ha - hs + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(hs < LEAST_WEIGHT) | (ha - hs < LEAST_WEIGHT)] = -1
            best = gain.reshape(width_nodes, -1).argmax(1)
            for k in range(width_nodes):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        margin += leaf[at]
        for part, value in zip(out, (feature, cut, leaf), strict=True):
            part.append(value)
    return Trees(base, *map(np.array, out))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches):
            x = docstats.features(chunk)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), rows], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


def sampled(labels: DataFrame, train: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most about ``max_rows`` usable labels, picked by a hash of doc_id."""
    usable = labels.where(train & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    n = usable.count()
    if n <= max_rows:
        return usable
    return usable.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))


def train(stats: DataFrame, labels: DataFrame, rows: Column, max_rows: int = MAX_ROWS) -> Trees:
    """Fit on the statistics of the labelled documents among ``rows``."""
    picked = F.broadcast(sampled(labels, rows, max_rows))  # at most max_rows small rows
    found = stats.join(picked, "doc_id").select("doc_id", "x", F.col("quality").cast("double").alias("y"))
    # Rows of repeated doc_ids can be more; a hash of what is in them picks the same ones in every run.
    found = found.withColumn("h", F.xxhash64("doc_id", "x", "y")).orderBy("h", "doc_id").limit(2 * max_rows).toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    width = len(docstats.FEATURES)
    x = np.asarray(found["x"].combine_chunks().flatten(), np.float32).reshape(-1, width)
    return fit(x, np.asarray(found["y"], np.float64))


def score(docs: DataFrame, labels: DataFrame, rows: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id and score of every document; ``rows`` says which labels may be learnt."""
    stats = Scratch(docs.sparkSession, "quality").save(statistics(docs), "stats")
    model = docs.sparkSession.sparkContext.broadcast(train(stats, labels, rows, max_rows))
    width = len(docstats.FEATURES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float32).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, rows: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents, with all their columns, that the model accepts."""
    picked = F.broadcast(sampled(labels, rows, max_rows).select("doc_id"))
    labelled = docs.select("doc_id", "text").join(picked, "doc_id", "left_semi")
    model = docs.sparkSession.sparkContext.broadcast(train(statistics(labelled), labels, rows, max_rows))

    @F.arrow_udf("double")
    def good(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        parts = [model.value.score(docstats.features(chunk)) for chunk in A.chunks([batch])]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(good("text") >= 0.5)
