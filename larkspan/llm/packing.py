"""Packing by cutting-stock column generation.

Documents are tokenised once and cut into pieces of at most one sequence; what
the driver sees is the histogram of piece lengths, at most one number per length
class.  A linear program over patterns (how many pieces of each class share a
sequence) is solved by column generation: a knapsack dynamic program prices
columns by the current duals.  Solutions are rounded down and the rest, which is
bounded by the number of classes and not by the data, is packed first-fit by
decreasing length.  Pieces are then ranked within their class and the rank says,
by arithmetic on the pattern table, which sequence a piece goes to.

Ranks are dealt by counting in many buckets of a class and numbering inside a
bucket, so that no task sorts a whole class.  They follow doc_id, the text's fingerprint
and the place of the piece, so the layout of the input files does not matter.

Defined cases: a null or empty text is its end token alone; repeated rows are
packed each; an empty table gives no pieces; a null doc_id stays null; a text and its
tokens are held whole in one task, which takes about 60 times its bytes.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays as A
from .scratch import Scratch

LENGTH = 2048
END = 1
#: Tokens per length class; a piece counts as its class's longest.
GRID = 2
BUCKET_ROWS = 20_000
#: Column generation stops when no column improves, within this part of the lower bound, or after so many
#: columns; any basic solution is a right packing, only a little longer.
GAP, COLUMNS = 1e-4, 1500
#: Patterns that are priced at once and tried before new ones are.
POOL = 8

#: The vocabulary's one special token and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


@lru_cache(2)
def _encoders(vocabulary: str, ranks: str):
    """The vocabulary's tokenizer and an equal, faster one for texts without special tokens."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return Tokenizer.from_file(vocabulary), fast


def default_vocabulary() -> tuple[str, str]:
    """Paths of the vocabulary and of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(text: str, paths: tuple[str, str]) -> list[int]:
    slow, fast = _encoders(*paths)
    if SPECIAL in text:
        return slow.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


_PIECE = "doc_id long, fp long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(length: int, paths: tuple[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches):
            out: list[list] = [[], [], [], [], [], []]
            ids = zip(chunk.column("doc_id").to_pylist(), chunk.column("fp").to_pylist(), pc.fill_null(chunk.column("text"), "").to_pylist(), strict=True)
            for doc_id, fp, text in ids:
                codes = np.array([*encode(text, paths), END], "<u4")
                for start in range(0, len(codes), length):
                    piece = codes[start : start + length]
                    for column, x in zip(out, (doc_id, fp, start, len(piece), zlib.crc32(piece.tobytes()), len(codes)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "fp", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, length: int = LENGTH, paths: tuple[str, str] | None = None) -> DataFrame:
    """Tokenise whole texts and cut them at multiples of ``length``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text").mapInArrow(_pieces(length, paths or default_vocabulary()), _PIECE)


def _price(sizes: np.ndarray, worth: np.ndarray, capacity: int, most: int = 1) -> tuple[float, np.ndarray]:
    """The value of the best pattern, and up to ``most`` patterns, one row each.

    An unbounded knapsack by dynamic programming; the patterns are the best ones
    that hold each of the most promising classes.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()  # sizes ascend
    for c in range(1, capacity + 1):
        top = best[c - 1]
        if k := fit[c]:
            values = best[c - sizes[:k]]
            values += worth[:k]
            i = values.argmax()
            if values[i] > top + 1e-12:
                top, choice[c] = values[i], i
        best[c] = top
    last = np.maximum.accumulate(np.where(choice >= 0, np.arange(capacity + 1), 0)).tolist()
    items, weights = choice.tolist(), sizes.tolist()
    held = worth + best[capacity - sizes]
    chosen = np.argsort(-held, kind="stable")[:most]
    patterns = np.zeros((len(chosen), len(sizes)), np.int64)
    for pattern, i in zip(patterns, chosen.tolist(), strict=True):
        pattern[i] += 1
        c = last[capacity - weights[i]]
        while c > 0:
            pattern[items[c]] += 1
            c = last[c - weights[items[c]]]
    return float(best[capacity]), np.unique(patterns, axis=0)


def _start(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A first basis: fractional first-fit by decreasing size.

    Each pattern is used until one of its classes runs out, and later patterns do
    without that class, so the columns are independent.
    """
    left, alive = demand.astype(np.float64).copy(), list(range(len(sizes)))  # sizes ascend
    columns, x = [], []
    while alive:
        pattern, room, top = np.zeros(len(sizes), np.int64), capacity, len(alive)
        own = sizes[alive]
        while top and room >= own[0]:
            top = min(top, int(np.searchsorted(own, room, "right")))
            if not top:
                break
            i = alive[top - 1]
            pattern[i] = k = min(room // sizes[i], max(1, int(left[i])))
            room -= k * sizes[i]
            top -= 1
        inside = np.flatnonzero(pattern)
        times = (left[inside] / pattern[inside]).min()
        left[inside] -= times * pattern[inside]
        columns.append(pattern)
        x.append(times)
        gone = [i for i in inside.tolist() if left[i] <= 1e-9 * demand[i]]
        for i in gone[1:]:
            columns.append((np.arange(len(sizes)) == i).astype(np.int64) * (capacity // sizes[i]))
            x.append(0.0)
        alive = [i for i in alive if i not in gone]
    return columns, np.array(x)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchanges, without threads of a linear algebra library."""
    m = len(matrix)
    work = np.concatenate([matrix.astype(np.float64), np.eye(m)], 1)
    for i in range(m):
        pivot = i + int(np.abs(work[i:, i]).argmax())
        work[[i, pivot]] = work[[pivot, i]]
        work[i] /= work[i, i]
        rows = np.flatnonzero(work[:, i])
        rows = rows[rows != i]
        work[rows] -= work[rows, i][:, None] * work[i]
    return work[:, m:]


class Solution(NamedTuple):
    """A fractional cutting stock: columns, how often each is used, those that are patterns, and how many were priced in."""

    columns: list[np.ndarray]
    uses: np.ndarray
    is_pattern: np.ndarray
    priced: int


def generate(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> Solution:
    """Column generation: a revised simplex whose columns are patterns, or the surplus of a class.

    It ends when no pattern is worth more than 1, or when the sequences are as full as can be.
    """
    m = len(sizes)
    columns, x = _start(sizes, demand, capacity)
    cost, priced = np.ones(m), 0
    least = float((sizes * demand).sum()) / capacity
    inverse, pool = _inverse(np.stack(columns, 1)), np.zeros((0, m), np.int64)
    while priced < COLUMNS:
        duals = np.einsum("i,ij->j", cost, inverse)
        worst = int(duals.argmin())
        if duals[worst] < -1e-9:
            column, price = -(np.arange(m) == worst).astype(np.int64), 0.0
        else:
            worth, price = np.maximum(duals, 0), 1.0
            values = np.einsum("ij,j->i", pool, worth)
            if values.max(initial=0) <= 1 + GAP:  # no pattern at hand improves; price new ones
                value, pool = _price(sizes, worth, capacity, POOL)
                if value <= 1 + GAP or float((cost * x).sum()) <= (1 + GAP) * least:
                    break
                values = np.einsum("ij,j->i", pool, worth)
            column = pool[int(values.argmax())]
        move = np.einsum("ij,j->i", inverse, column.astype(np.float64))
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * move, 0)
        x[out] = ratio[out]
        row = inverse[out] / move[out]
        some = np.flatnonzero(np.abs(move) > 1e-12)
        inverse[some] -= move[some, None] * row
        inverse[out] = row
        columns[out], cost[out] = column, price
        priced += 1
    return Solution(columns, x, cost > 0, priced)


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns that are used once or more, and how often."""
    found = generate(sizes, demand, capacity)
    return [(c, float(n)) for c, n, p in zip(found.columns, found.uses, found.is_pattern, strict=True) if p and n >= 1]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns that hold every piece exactly once: ({class: pieces}, uses)."""
    left = dict(histogram)
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(left[s] // k for s, k in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for s, k in pattern.items():
                left[s] -= k * times

    if left.get(capacity):
        use({capacity: 1}, left[capacity])
    sizes = np.array(sorted(s for s, n in left.items() if n), np.int64)
    if len(sizes):
        demand = np.array([left[int(s)] for s in sizes], np.float64)
        for column, times in sorted(solve(sizes, demand, capacity), key=lambda p: (-p[1], p[0].tolist())):
            use({int(s): int(k) for s, k in zip(sizes, column, strict=True) if k}, int(times + 1e-6))
    while rest := sorted((s for s, n in left.items() if n), reverse=True):
        pattern, room = {}, capacity
        for s in rest:
            if k := min(left[s], room // s):
                pattern[s] = k
                room -= k * s
        use(pattern, max(1, min(left[s] // k for s, k in pattern.items())))
    return out


def pack(docs: DataFrame, length: int = LENGTH, grid: int = GRID, paths: tuple[str, str] | None = None) -> DataFrame:
    """Every piece with the sequence it goes to and its place there."""
    spark = docs.sparkSession
    work = Scratch(spark, "packing")
    cut = work.save(pieces(docs, length, paths).withColumn("cls", F.ceil(F.col("length") / grid).cast("int")), "pieces")
    histogram = {r["cls"]: r["n"] for r in cut.groupBy("cls").agg(F.count("*").alias("n")).collect()}  # at most length / grid rows
    rows, sequence, used = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in plan(histogram, length // grid):
        for cls, k in pattern.items():
            rows.append((cls, used[cls], used[cls] + k * times, k, sequence))
            used[cls] += k * times
        sequence += times
    # A few rows for each class: the patterns in the solution are at most as many as classes.
    table = F.broadcast(spark.createDataFrame(rows, "p_cls int, lo long, hi long, k long, first long"))

    # Each class has buckets for its own number of pieces, so one that holds many is dealt widely.
    buckets = F.array(*[F.lit(histogram.get(c, 0) // BUCKET_ROWS + 4).cast("long") for c in range(length // grid + 1)])
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "fp", "start"), F.element_at(buckets, F.col("cls") + 1)))
    sizes = dealt.groupBy(F.col("cls").alias("s_cls"), F.col("bucket").alias("s_bucket")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("s_cls").orderBy("s_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("s_cls", "s_bucket", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("cls", "bucket").orderBy("doc_id", "fp", "start")) - 1
    ranked = dealt.withColumn("inside", inside).join(sizes, (F.col("cls") == F.col("s_cls")) & (F.col("bucket") == F.col("s_bucket")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside"))
    placed = ranked.join(table, (F.col("cls") == F.col("p_cls")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.withColumn("sequence_id", (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("k"))).cast("long"))
    # A sequence has at most ``length`` pieces.
    ahead = F.sum("length").over(W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "fp", "start").rowsBetween(W.unboundedPreceding, -1))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(ahead, F.lit(0)).cast("long").alias("offset"))
