"""Sharding by a weighted hash tree of regions, racks and shards.

A row descends the tree.  At each level every child of its node draws an exponential
variate from the hash of (doc_id, level, child), divides it by the summed weight below
the child, and the least draw wins: a weighted draw.  Only the children of the winners
draw, so a row costs the tree's depth times its fan-out and not the number of shards.

A changed weight alters the draws on the path from the root to its shard and no others,
so a row moves only into, out of or within the largest subtree whose weight changed: the
shard's region, or its rack where the region's sum stays.  A shard that opens a region of
its own, as the 25th does here, takes rows only into itself.

Slots number the rows of a shard without gaps.  They are dealt by counting rows
in many buckets of a shard and numbering inside a bucket, so no task sorts a
whole shard.

Defined cases: a null text has no bytes, size 8 and checksum 0; a null doc_id is
hashed as an empty key; rows with one doc_id share a shard and get slots of
their own, in order of their text's fingerprint; an empty table gives no rows;
weights must be numbers of 0 or more, one at least above 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS = 24
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 4
#: Rows numbered together, on average.
BUCKET_ROWS = 20_000
OVERHEAD = 8


def topology(shard: int) -> tuple[int, int]:
    """Region and rack of a shard: racks of four, regions of two racks, in order.

    A shard keeps its place when the count grows.
    """
    return shard // (RACKS_PER_REGION * SHARDS_PER_RACK), shard // SHARDS_PER_RACK


def _draw(key: Column, level: int, node: Column, weight: Column) -> Column:
    """An exponential variate of a node with its weight as the rate; infinite without weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node.cast("int")), 11).cast("double")
    return F.when(weight > 0, -F.log((bits + 0.5) / float(1 << 53)) / weight).otherwise(F.lit(float("inf")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used.

    A plain chain of columns would be multiplied out where a filter on the result
    is pushed down.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _winner(key: Column, level: int, first: Column, weights: list[float], fan: int) -> Column:
    """The node with the least draw among ``fan`` nodes from ``first``; ties go to the first."""
    table = F.array(*map(F.lit, weights))
    nodes = F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda i: first + i)
    draws = F.transform(nodes, lambda n: _draw(key, level, n, F.coalesce(F.get(table, n), F.lit(0.0))))
    return first + _let(draws, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def place(df: DataFrame, shards: int, weights: dict[int, float] | None = None, key: str = "doc_id", prefix: str = "") -> DataFrame:
    """Add columns region, rack and shard (with a prefix) by descending the tree."""
    hashed = F.coalesce(F.col(key).cast("string"), F.lit(""))
    leaves = [float((weights or {}).get(i, 1.0)) for i in range(shards)]
    racks = [sum(leaves[i : i + SHARDS_PER_RACK]) for i in range(0, shards, SHARDS_PER_RACK)]
    regions = [sum(racks[i : i + RACKS_PER_REGION]) for i in range(0, len(racks), RACKS_PER_REGION)]
    if min(leaves) < 0 or not sum(leaves) > 0:
        raise ValueError("weights must be 0 or more, and one above 0")
    path = _let(_winner(hashed, 0, F.lit(0), regions, len(regions)), lambda region: _let(
        _winner(hashed, 1, region * RACKS_PER_REGION, racks, RACKS_PER_REGION), lambda rack: F.struct(
            region.alias("region"), rack.alias("rack"),
            _winner(hashed, 2, rack * SHARDS_PER_RACK, leaves, SHARDS_PER_RACK).alias("shard"))))
    at = df.withColumn("__place", path)
    return at.withColumns({f"{prefix}{x}": F.col(f"__place.{x}") for x in ("region", "rack", "shard")}).drop("__place")


def with_slots(df: DataFrame, order: list[str], rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Number the rows of each shard from 0, bucket by bucket."""
    buckets = max(1, rows // (bucket_rows * SHARDS) + 1)
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(buckets)))
    sizes = df.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(F.col("shard").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("shard", "__bucket").orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    numbered = df.withColumn("__rank", inside - 1)
    # Null-safe: a plain equality would infer a filter that repeats the whole draw.
    same = F.col("shard").eqNullSafe(F.col("__s")) & F.col("__bucket").eqNullSafe(F.col("__b"))
    return numbered.join(sizes, same).withColumn("slot", (F.col("__before") + F.col("__rank")).cast("long")).drop("__bucket", "__before", "__rank", "__s", "__b")


def shard_documents(docs: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None, grow: bool = True) -> DataFrame:
    """Each document's size, checksum, place in the tree and slot.

    ``grown_shard`` is the place with one more shard of weight 1.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("__fp"),
    )
    placed = place(rows, shards, weights)
    if grow:
        placed = place(placed, shards + 1, weights, prefix="grown_")
    return with_slots(placed, ["doc_id", "__fp"], docs.count()).drop("__fp")
