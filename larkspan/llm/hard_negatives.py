"""Hard negatives by a two-dimensional block matrix multiply.

Rows have integer components.  Anchors are dealt into strips of about ANCHORS, all rows
into strips of about ROWS, and the dimensions are cut into chunks.  Each panel of a strip
(its rows, one chunk) goes to the tiles of its strip; one task row multiplies an anchor
panel by a row panel, which gives a partial tile of int64 scores, and the partial tiles of
a tile are shuffled together and added.  A tile leaves only its best entries:

1. Anchors meet the rows of their own label: per anchor the best ``top`` are its positives.
2. Anchors, with the scores of their positives, meet all rows: per anchor and positive the
   best ``top`` rows of another label whose score is in the window from ``floor`` percent of
   the positive's score up to that score.

The best of all tiles are ranked per anchor (and positive), limited before the shuffle.
Products use float64 where every sum is below 2**53 and hence exact, and int64 elsewhere.
A strip is a draw by the hash of the id, so one label with a third of the rows is many tiles.

Work is anchors times rows, as every anchor is to be held against every row; memory is that
of a few panels and one tile's partial sums (CHUNKS at most).

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component
take no part, nor do those whose components have a sum of squares of 2**60 or more (no score
of the others leaves 64 bits); a missing component is 0; of rows with one id that with the
least (label, vector) takes part; ties go to the smaller id; an anchor without positives, and
a positive without negatives, has no row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keys import sent
from .scratch import Scratch

#: Anchors and rows of a strip, about; a tile is their product.
ANCHORS, ROWS = 256, 2048
#: Dimensions of a chunk at least, and the most chunks.
WIDTH, CHUNKS = 32, 8
#: Pairs of panels in a partition (some 0.6 MB each at WIDTH dimensions).
PAIRS = 16
#: The sum of squares from which a vector takes no part.
LARGEST = float(1 << 60)
_NONE = np.iinfo(np.int64).min

_PRODUCTS = "g long, r int, c int, k int, tile binary, a_id array<long>, a_label array<long>, p_id array<array<long>>, p_score array<array<long>>, b_id array<long>, b_label array<long>"
_POSITIVES = "anchor_id long, positive_id long, positive_score long"
_NEGATIVES = f"{_POSITIVES}, negative_id long, negative_score long"


def vectors(rows: DataFrame, vec_id: str, label: Column, vector: str, scale: float, work: Scratch) -> DataFrame:
    """id, label and integer components floor(scale * x) of the rows that take part; a written table."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    some = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    some = some.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    floors = some.select("id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    floors = work.save(floors.where(square < LARGEST), "vectors")
    twice, n = work.counted(floors.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "twice")
    if not n:
        return floors
    twice = sent(twice, n)
    one = floors.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")
    return work.save(floors.join(twice, "id", "left_anti").unionByName(one), "single")


def _panels(rows: DataFrame, strip: str, others: str, dims: int, *more: str) -> DataFrame:
    """Each strip's rows by chunk of dimensions, repeated for every strip that it meets.

    ``rows`` has g, ``strip``, the number ``others`` of strips that it meets, id, label, v
    and further columns, which go with the first chunk only.
    """
    width = max(WIDTH, -(-dims // CHUNKS))
    n = max(1, -(-dims // width))
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(n * width) - F.size("v")))
    cut = rows.select("g", strip, others, "id", "label", *more, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("k"), F.slice(padded, k * width + 1, width).alias("part")))).alias("x"))
    first = [F.when(F.col("x.k") == 0, F.col(m)).alias(m) for m in more]
    lists = cut.groupBy("g", strip, others, F.col("x.k").alias("k")).agg(F.sort_array(F.collect_list(F.struct("id", "label", F.col("x.part").alias("part"), *first))).alias(f"{strip}_rows"))
    other = "c" if strip == "r" else "r"
    return lists.select("g", strip, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other), "k", f"{strip}_rows")


def _numbers(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def _multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partial tile for each pair of panels."""
    schema = pa.schema([("g", pa.int64()), ("r", pa.int32()), ("c", pa.int32()), ("k", pa.int32()), ("tile", pa.binary()), *((x, pa.list_(pa.int64())) for x in ("a_id", "a_label")), *((x, pa.list_(pa.list_(pa.int64()))) for x in ("p_id", "p_score")), *((x, pa.list_(pa.int64())) for x in ("b_id", "b_label"))])
    for batch in batches:
        for i in range(batch.num_rows):
            at = {x: batch.column(batch.schema.get_field_index(x))[i].as_py() for x in ("g", "r", "c", "k")}
            a, b = (batch.column(batch.schema.get_field_index(x)).slice(i, 1).flatten() for x in ("r_rows", "c_rows"))
            x, y = (_numbers(z.field("part").flatten()).reshape(len(z), -1) for z in (a, b))
            bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
            tile = (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64) if bound < 2**53 else x @ y.T
            ids = [None] * 6
            if at["k"] == 0:
                known = {f.name for f in a.type}
                ids = [a.field("id").to_pylist(), a.field("label").to_pylist(), *(a.field(p).to_pylist() if p in known else None for p in ("p_id", "p_score")), b.field("id").to_pylist(), b.field("label").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*at.values(), tile.tobytes(), *ids], schema, strict=True)], schema=schema)


def _added(tiles: pa.Table) -> tuple[np.ndarray, dict[str, list]]:
    """The sum of the partial tiles of one tile, and what came with the first chunk."""
    ks = tiles.column("k").to_pylist()
    row = {x: tiles.column(x)[ks.index(0)].as_py() for x in ("a_id", "a_label", "p_id", "p_score", "b_id", "b_label")}
    total = np.zeros((len(row["a_id"]), len(row["b_id"])), np.int64)
    for x in tiles.column("tile"):
        total += np.frombuffer(x.as_buffer(), np.int64).reshape(total.shape)
    return total, row


def _best(scores: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and scores of the best, second best and so on of each row; the first of equal ones is better."""
    each = np.arange(len(scores))
    for _ in range(min(top, scores.shape[1])):
        column = scores.argmax(axis=1)
        value = scores[each, column]
        there = np.flatnonzero(value > _NONE)
        if not len(there):
            return
        yield there, column[there], value[there]
        scores[each, column] = _NONE


def _positives(tiles: pa.Table, top: int) -> pa.Table:
    score, row = _added(tiles)
    a_id, b_id = np.array(row["a_id"]), np.array(row["b_id"])
    score[a_id[:, None] == b_id[None, :]] = _NONE
    out = [(a_id[i], b_id[j], s) for i, j, s in _best(score, top)]
    columns = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 3)]
    return pa.table([pa.array(x, pa.int64()) for x in columns], ["anchor_id", "positive_id", "positive_score"])


def _negatives(tiles: pa.Table, top: int, parts: tuple[int, int]) -> pa.Table:
    score, row = _added(tiles)
    low, high = parts
    a_id, b_id = np.array(row["a_id"]), np.array(row["b_id"])
    score[np.array(row["a_label"])[:, None] == np.array(row["b_label"])[None, :]] = _NONE
    out = []
    for n in range(max((len(p) for p in row["p_id"]), default=0)):
        some = np.array([i for i, p in enumerate(row["p_id"]) if len(p) > n])
        p_id, p = (np.array([row[x][i][n] for i in some]) for x in ("p_id", "p_score"))
        mine = score[some]
        # Scores are below 2**60, so both products fit.
        floor = -(-(low * p) // high)
        mine[(mine < floor[:, None]) | (mine > p[:, None])] = _NONE
        out += [(a_id[some[i]], p_id[i], p[i], b_id[j], s) for i, j, s in _best(mine, top)]
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
    return pa.table([pa.array(x, pa.int64()) for x in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def _tiles(anchors: DataFrame, rows: DataFrame, dims: int, n: int) -> DataFrame:
    """The partial tiles of about ``n`` pairs of strips."""
    parts = max(1, n * CHUNKS // PAIRS)
    key = ["g", "r", "c", "k"]
    more = [x for x in ("p_id", "p_score") if x in anchors.columns]
    left = _panels(anchors, "r", "cs", dims, *more).repartition(parts, *key)
    right = _panels(rows, "c", "rs", dims).repartition(parts, *key)
    # Both sides grow with the rows, so neither is broadcast.
    return left.join(right.hint("merge"), key).mapInArrow(_multiply, _PRODUCTS)


def _strip(n: Column | str) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def positives(rows: DataFrame, anchor: Column, work: Scratch, top: int = 5) -> DataFrame:
    """anchor_id, positive_id, positive_score and rank of the best rows of each anchor's label."""
    up = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    labels = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(anchor).alias("m")).where("m > 0")
    labels, found = work.counted(labels.select(F.col("label").alias("g"), up("m", ANCHORS).alias("rs"), up("n", ROWS).alias("cs")), "labels")
    size = rows.agg(F.max(F.size("v")).alias("dims")).first()
    pairs = labels.agg(F.sum(F.col("rs") * F.col("cs")).alias("n")).first()["n"] or 0
    mine = rows.join(sent(labels, found), F.col("label") == F.col("g"))
    left = mine.where(anchor).select("g", _strip("rs").alias("r"), "cs", "id", "label", "v")
    right = mine.select("g", _strip("cs").alias("c"), "rs", "id", "label", "v")

    def reduced(tiles: pa.Table) -> pa.Table:
        return _positives(tiles, top)

    best = _tiles(left, right, size["dims"] or 0, pairs).groupBy("g", "r", "c").applyInArrow(reduced, _POSITIVES)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top)


def mine(rows: DataFrame, anchor: Column, work: Scratch, top: int = 5, floor: int = 80) -> DataFrame:
    """The best negatives in the window of each anchor and positive.

    ``rows`` is a table of ``vectors``, ``anchor`` a condition on its id or label.
    """
    found = work.save(positives(rows, anchor, work, top), "positives")
    lists = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    lists = work.save(lists.select("anchor_id", F.col("p.positive_id").alias("p_id"), F.col("p.positive_score").alias("p_score")), "anchors")
    n, m, dims = rows.agg(F.count("*"), F.count_if(anchor), F.max(F.size("v"))).first()
    rs, cs = max(1, -(-m // ANCHORS)), max(1, -(-n // ROWS))
    zero, strips = F.lit(0).cast("long").alias("g"), (F.lit(rs).alias("rs"), F.lit(cs).alias("cs"))
    left = rows.where(anchor).join(lists, F.col("id") == F.col("anchor_id")).select(zero, _strip(F.lit(rs)).alias("r"), strips[1], "id", "label", "v", "p_id", "p_score")
    right = rows.select(zero, _strip(F.lit(cs)).alias("c"), strips[0], "id", "label", "v")
    common = np.gcd(floor, 100)
    window = (int(floor // common), int(100 // common))

    def reduced(tiles: pa.Table) -> pa.Table:
        return _negatives(tiles, top, window)

    best = _tiles(left, right, dims or 0, rs * cs).groupBy("g", "r", "c").applyInArrow(reduced, _NEGATIVES)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
