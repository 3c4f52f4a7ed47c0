"""Joins in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(df: DataFrame, key: str, order: list[str], when: Column, value: str, out: str) -> DataFrame:
    """As-of lookup in one table: the last earlier value of the key where ``when`` holds."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(when, F.col(value)), ignorenulls=True).over(before))


#: Rows of a key from which its time is cut into cells, and about the rows of a cell.
HOT = 100_000


def _cells(rows: DataFrame, hot: int) -> DataFrame:
    """k and the times ``cuts`` that part its rows evenly, for each key of more than ``hot`` rows.

    There are at most as many such keys as the rows have times ``hot``, and the cuts of a
    key are an approximate quantile for each ``hot`` of its rows.
    """
    counts = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    parts = F.least(F.ceil(F.col("n") / hot).cast("int") * 2, F.lit(2_000))
    many = rows.join(F.broadcast(counts), "k")
    # One aggregate makes a bounded summary of a key in each task; the cuts are read off it.
    found = many.groupBy("k").agg(F.percentile_approx(F.unix_micros("t"), F.array(*(F.lit(i / 200) for i in range(1, 200))), 2_000).alias("q"), F.first(parts).alias("parts"))
    every = F.transform(F.sequence(F.lit(1), F.least(F.col("parts"), F.lit(200)) - 1), lambda i: F.element_at("q", F.greatest(F.lit(1), F.floor(i * 200 / F.least(F.col("parts"), F.lit(200))).cast("int"))))
    return found.select(F.col("k").alias("hot_k"), F.array_sort(F.array_distinct(every)).alias("cuts"))


def asof(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str], hot: int = HOT) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the key's last row of ``right`` at or before it.

    Both sides are put in one order and the last row of ``right`` is carried forward, so
    rows are not multiplied.  A key of more than ``hot`` rows is cut into cells of time, which
    are ordered each by itself; in a second pass over one row a cell, the last row of ``right``
    of each cell is carried into the next ones.  Times of ``right`` are unique within a key; a
    row of ``left`` without an earlier one, or with a null key or time, has nulls.
    """
    left_type = left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType
    right_type = right.select(F.struct(*values).alias("x")).schema["x"].dataType
    one = left.select(F.col(key).alias("k"), F.col(left_at).cast("timestamp").alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right_type).alias("found"))
    two = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(F.col(key).alias("k"), F.col(right_at).cast("timestamp").alias("t"), F.lit(0).alias("side"), F.lit(None).cast(left_type).alias("row"), F.struct(*values).alias("found"))
    known = F.col("k").isNotNull() & F.col("t").isNotNull()
    outside = one.where(~known)
    rows = one.where(known).unionByName(two)
    cells = _cells(rows.select("k", "t"), hot)
    dealt = rows.join(F.broadcast(cells), F.col("k") == F.col("hot_k"), "left")
    cell = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.unix_micros("t"))), F.lit(0))
    dealt = dealt.withColumn("cell", cell).drop("hot_k")
    # The second pass: hot keys alone have more than one cell.
    heads = dealt.where("cuts IS NOT NULL").groupBy("k", "cell").agg(F.max_by(F.when(F.col("side") == 0, F.col("found")), F.when(F.col("side") == 0, F.col("t"))).alias("last"))
    earlier = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select("k", F.lit(None).cast("timestamp").alias("t"), F.lit(0).alias("side"), F.lit(None).cast(left_type).alias("row"), F.last("last", ignorenulls=True).over(earlier).alias("found"), "cell").where("found IS NOT NULL")
    order = Window.partitionBy("k", "cell").orderBy(F.asc_nulls_first("t"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = dealt.drop("cuts").unionByName(carried).withColumn("found", F.last("found", ignorenulls=True).over(order)).where("side = 1")
    return every.select("row", "found").unionByName(outside.select("row", "found")).select("row.*", *(F.col("found")[v].alias(v) for v in values))


def within(df: DataFrame, key: str, at: str, ident: str, seconds: int) -> DataFrame:
    """Ordered pairs of one key at most ``seconds`` apart.

    Rows meet in time cells of that length and the next, so the work follows the
    density in time and not the square of a key's rows.
    """
    left = df.select(F.col(key), F.col(ident).alias("left_id"), F.col(at).alias("left_at"))
    right = df.select(F.col(key), F.col(ident).alias("right_id"), F.col(at).alias("right_at"))
    cell = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    left = left.withColumn("cell", F.explode(F.array(cell("left_at"), cell("left_at") + 1)))
    right = right.withColumn("cell", cell("right_at"))
    limit = F.col("left_at") + F.make_dt_interval(secs=F.lit(seconds))
    same = left.join(right, [key, "cell"]).where((F.col("left_id") < F.col("right_id")) & (F.col("right_at") >= F.col("left_at")) & (F.col("right_at") <= limit))
    return same.drop("cell")
