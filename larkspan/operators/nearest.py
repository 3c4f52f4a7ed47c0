"""Nearest vectors by cosine: exact in blocks, and by inverted lists over every row.

Both compare a set of queries with rows that share a cell: one cell for all rows where the
answer is to be exact, the cells nearest to a query where an index is used.  The rows of a
cell are dealt to strips of about ROWS, its queries to strips of about QUERIES, and a pair of
strips is one group and one matrix product that leaves the best of each query; these are ranked in the end.
So a cell with a third of the rows is many tasks.

The index is fitted on a bounded sample: CELLS centroids at most, of at most SAMPLE vectors,
chosen by the hash of their ids.  Every row is then put into the list of its nearest centroid,
none is left out; how many lists a query looks into is audited against exact answers.

Vectors that are null, zero or empty, or hold a null or non-finite component, take no part;
a missing component is 0.  Ids are unique.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES = 4_096, 512
SAMPLE, CELLS, ROUNDS = 20_000, 1_024, 12
#: Queries of an audit, at most.
AUDIT = 64


def units(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """id, u: the vectors that take part, at length 1."""
    some = df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id IS NOT NULL AND size(x) > 0")
    return some.mapInArrow(_scaled, "id long, u array<double>")


def _scaled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        start = np.cumsum(size) - size
        top = np.maximum.reduceat(np.abs(x), start)
        good = np.isfinite(top) & (top > 0)
        x = x / np.repeat(np.where(good, top, 1.0), size)
        x /= np.repeat(np.sqrt(np.where(good, np.add.reduceat(x * x, start), 1.0)), size)
        kept = pa.array(np.flatnonzero(good))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(x)].astype(np.int32)), pa.array(x))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), lists.take(kept)], ["id", "u"])


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows, with zeros where components are missing."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _panels(df: DataFrame, side: str, strips: Column, other: str, others: Column, size: int) -> DataFrame:
    """The rows of each cell's strips as lists, repeated for the strips of the other side."""
    at = F.pmod(F.xxhash64("id"), strips).cast("int")
    lists = df.select("cell", at.alias(side), others.alias("n_other"), "id", "u").groupBy("cell", side, "n_other").agg(F.collect_list(F.struct("id", "u")).alias(f"{side}_rows"))
    return lists.select("cell", side, F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)).alias(other), f"{side}_rows")


def best(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, id, sim and place of the ``k`` rows most alike to each query among those of its cells.

    ``queries`` and ``rows`` have cell, id and u.  A query is not its own answer; of equal
    similarities (to 12 digits) the smaller id comes first.
    """
    up = lambda c, size: F.ceil(F.coalesce(F.col(c), F.lit(0)) / size).cast("int")
    counts = queries.groupBy("cell").agg(F.count("*").alias("q_n")).join(rows.groupBy("cell").agg(F.count("*").alias("r_n")), "cell")
    counts = counts.select("cell", up("q_n", QUERIES).alias("qs"), up("r_n", ROWS).alias("rs"))  # a row a cell, CELLS at most
    left = _panels(queries.join(F.broadcast(counts), "cell"), "q", F.col("qs"), "r", F.col("rs"), QUERIES)
    right = _panels(rows.join(F.broadcast(counts), "cell"), "r", F.col("rs"), "q", F.col("qs"), ROWS)

    def tile(some: pa.Table, others: pa.Table) -> pa.Table:
        """The best of a pair of strips: a task holds one pair at a time, however many it has."""
        found = [pa.RecordBatch.from_pydict({"query_id": [], "id": [], "sim": []}, schema=pa.schema({"query_id": pa.int64(), "id": pa.int64(), "sim": pa.float64()}))]
        if not len(some) or not len(others):
            return pa.Table.from_batches(found)
        a, b = (t.column(f"{side}_rows").chunk(0).flatten() for t, side in ((some, "q"), (others, "r")))
        x, y = (z.field("u") for z in (a, b))
        width = max(pc.max(z.value_lengths()).as_py() for z in (x, y))
        p, q = (z.field("id").to_numpy(zero_copy_only=False) for z in (a, b))
        place = np.argsort(q)
        q = q[place]
        sims = np.round(_matrix(x, width) @ _matrix(y, width)[place].T, 12)
        sims[p[:, None] == q[None, :]] = -np.inf
        for _ in range(min(k, len(q))):  # the first of equal ones has the smaller id
            at = sims.argmax(axis=1)
            value = sims[np.arange(len(p)), at]
            good = value > -np.inf
            found.append(pa.RecordBatch.from_arrays([pa.array(p[good]), pa.array(q[at[good]]), pa.array(value[good])], ["query_id", "id", "sim"]))
            sims[np.arange(len(p)), at] = -np.inf
        return pa.Table.from_batches(found).combine_chunks()

    # A group is one row of each side; batches of joined rows would hold all pairs of a task.
    pair = ["cell", "q", "r"]
    found = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(tile, "query_id long, id long, sim double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def exact(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows most alike to each query; both have id and u."""
    return best(queries.withColumn("cell", F.lit(0)), rows.withColumn("cell", F.lit(0)), k)


@dataclass(frozen=True)
class Index:
    """``lists`` has cell, id and u of every row; ``centroids`` are bounded by CELLS."""

    lists: DataFrame
    centroids: np.ndarray
    probes: int


def _near(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each vector."""
    sims = x @ centroids.T
    return np.argsort(-sims, axis=1, kind="stable")[:, :n]


def _in_cells(centroids: np.ndarray, n: int) -> object:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                some = batch.slice(at, 2_048)
                # Components beyond those of the fitted vectors do not tell centroids apart.
                longest = max(centroids.shape[1], pc.max(some.column(1).value_lengths()).as_py())
                cells = _near(_matrix(some.column(1), longest)[:, : centroids.shape[1]], centroids, n)
                for j in range(cells.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(cells[:, j].astype(np.int32)), some.column(0), some.column(1)], ["cell", "id", "u"])

    return run


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by their directions."""
    centroids = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(rounds):
        cell = _near(sample, centroids, 1)[:, 0]
        total = np.zeros_like(centroids)
        np.add.at(total, cell, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(length > 0, total / np.maximum(length, 1e-300), centroids)
    return centroids


def build(rows: DataFrame, path: str, recall: float = 0.95, k: int = 5) -> Index:
    """Lists of every row of ``rows`` (id, u), written to ``path`` sorted by cell.

    Queries look into as few lists as find ``recall`` of the exact answers of AUDIT rows.
    """
    spark = rows.sparkSession
    n, dims = rows.agg(F.count("*"), F.max(F.size("u"))).first()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    width = max(1, dims or 1)
    vectors = _matrix(sample.column("u").combine_chunks(), width) if len(sample) else np.zeros((1, width))
    centroids = fitted(vectors, max(1, min(CELLS, int(np.sqrt(n or 1)))))
    listed = rows.mapInArrow(_in_cells(centroids, 1), "cell int, id long, u array<double>")
    listed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.parquet(path)
    lists = spark.read.schema("cell int, id long, u array<double>").parquet(path)
    asked = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(AUDIT)
    right = exact(asked, rows, k).select("query_id", "id").collect()  # AUDIT times k rows at most
    want, probes = {tuple(r) for r in right}, 1
    while probes < len(centroids):
        found = best(asked.mapInArrow(_in_cells(centroids, probes), "cell int, id long, u array<double>"), lists, k)
        if len(want & {tuple(r) for r in found.select("query_id", "id").collect()}) >= recall * len(want):
            break
        probes *= 2
    return Index(lists, centroids, min(probes, len(centroids)))


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows most alike to each query (id, u) among those of its nearest lists."""
    asked = queries.mapInArrow(_in_cells(index.centroids, index.probes), "cell int, id long, u array<double>")
    return best(asked, index.lists, k)
