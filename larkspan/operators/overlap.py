"""Joins of points and intervals, and of intervals and intervals, of any lengths.

No grid width is asked for: the line is cut at quantiles of the bounds into SIDE * SIDE cells,
gathered by SIDE into as many large ones.  An interval is listed under the large cells that it
spans and the small ones at its ends, at most 3 * SIDE rows however long it is; a point is
listed under its small and its large cell.  A point meets an interval in exactly one of them,
so every pair comes once, by a join on equal cells.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = 64


def _free(name: str, *frames: DataFrame) -> str:
    """``name``, or the first of its variants that is no column of the frames."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cuts(values: DataFrame, side: int) -> list[list[float]]:
    """The upper bounds of small cells in each large cell, from the column ``v``: fewer than ``side`` squared numbers."""
    n = side * side
    found = values.agg(F.percentile_approx("v", [i / n for i in range(1, n)], 4 * n).alias("q")).head()["q"] or []
    found = sorted(set(found))
    return [found[i : i + side] for i in range(0, len(found), side)] or [[0.0]]


def _cell(value: Column, bounds: list[list[float]]) -> tuple[Column, Column]:
    """The large cell of a value, and the small one in it."""
    # One literal each, which is folded, in place of thousands of expressions.
    ends = F.from_json(F.lit(json.dumps([b[-1] for b in bounds])), "array<double>")
    cells = F.from_json(F.lit(json.dumps([b[:-1] for b in bounds])), "array<array<double>>")
    large = F.size(F.filter(ends, lambda b: b <= value))
    inner = F.try_element_at(cells, large + 1)
    return large, F.coalesce(F.size(F.filter(inner, lambda b: b <= value)), F.lit(0))


def _number(c: Column, kind: str) -> Column:
    return F.unix_micros(c.cast("timestamp")).cast("double") if kind.startswith(("timestamp", "date")) else c.cast("double")


def contains(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, inside: Column | None = None, side: int = SIDE) -> DataFrame:
    """Pairs of a point and an interval [lo, hi) that holds it; ``inside`` is another exact condition in its place.

    Nulls and empty intervals meet nothing.  Intervals so large that doubles cannot tell their
    bounds apart are still told apart by the exact condition.
    """
    kinds = dict(points.dtypes) | dict(spans.dtypes)
    inside = (F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi)) if inside is None else inside
    point, low, high = (_number(F.col(c), kinds[c]) for c in (at, lo, hi))
    both = spans.select(low.alias("v")).unionByName(spans.select(high.alias("v"))).unionByName(points.select(point.alias("v"))).where("v IS NOT NULL AND NOT isnan(v)")
    bounds = cuts(both, side)
    big, small = _free("cell_big", points, spans), _free("cell_small", points, spans)
    # The bounds never part a point from its own value: equal numbers are in one cell.
    p_big, p_small = _cell(point, bounds)
    listed = points.where(F.col(at).isNotNull()).withColumn(big, F.explode(F.array(F.struct(p_big.alias("big"), p_small.alias("small")), F.struct(p_big.alias("big"), F.lit(-1).alias("small")))))
    listed = listed.withColumn(small, F.col(f"{big}.small")).withColumn(big, F.col(f"{big}.big"))
    (a_big, a_small), (b_big, b_small) = _cell(low, bounds), _cell(high, bounds)
    every = lambda x, start, stop: F.transform(F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(x.alias("big"), i.alias("small")))
    same = every(a_big, a_small, b_small)
    middle = F.transform(F.when(a_big + 1 <= b_big - 1, F.sequence(a_big + 1, b_big - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("big"), F.lit(-1).alias("small")))
    apart = F.concat(every(a_big, a_small, F.lit(side)), middle, every(b_big, F.lit(0), b_small))
    cells = spans.where(F.col(lo) <= F.col(hi)).withColumn(big, F.explode(F.when(a_big == b_big, same).otherwise(apart)))
    cells = cells.withColumn(small, F.col(f"{big}.small")).withColumn(big, F.col(f"{big}.big"))
    return listed.join(cells, [big, small]).where(inside).drop(big, small)


def overlaps(left: DataFrame, left_lo: str, left_hi: str, right: DataFrame, right_lo: str, right_hi: str, side: int = SIDE) -> DataFrame:
    """Pairs of intervals [lo, hi) that share a point; the columns of the two sides differ in name.

    Two intervals overlap if the later of their starts is in the other one, so the pairs are
    those where the left one starts in the right one, and those where the right one starts
    in the left one and not at its start.  Empty intervals overlap nothing.
    """
    left, right = left.where(F.col(left_lo) < F.col(left_hi)), right.where(F.col(right_lo) < F.col(right_hi))
    columns = [*left.columns, *right.columns]
    one = contains(left, left_lo, right, right_lo, right_hi, side=side)
    two = contains(right, right_lo, left, left_lo, left_hi, (F.col(right_lo) > F.col(left_lo)) & (F.col(right_lo) < F.col(left_hi)), side=side)
    return one.select(*columns).unionByName(two.select(*columns))


def totals(left: DataFrame, left_lo: str, left_hi: str, right: DataFrame, right_lo: str, right_hi: str, side: int = SIDE) -> DataFrame:
    """``right`` with n and length: how many intervals of ``left`` overlap each of its rows, and in how much.

    Bounds are integers.  No pairs are made: up to a time t, those of ``left`` cover the sum of
    t - lo over those that began less the sum of t - hi over those that ended, so four running
    sums at the bounds of a row tell both.  They run in cells of about equal numbers of bounds.
    Empty intervals overlap nothing; rows that nothing overlaps are left out.
    """
    left, right = left.where(F.col(left_lo) < F.col(left_hi)), right.where(F.col(right_lo) < F.col(right_hi))
    zero = F.lit(0).cast("long")
    ends = left.select(F.explode(F.array(*(F.struct(F.col(c).cast("long").alias("v"), F.lit(i).alias("i")) for i, c in enumerate((left_lo, left_hi))))).alias("e")).select("e.*")
    is_hi = F.col("i") == 1
    sums = {"a": F.count_if(~is_hi), "sa": F.coalesce(F.sum(F.when(~is_hi, F.col("v"))), zero), "b": F.count_if(is_hi), "sb": F.coalesce(F.sum(F.when(is_hi, F.col("v"))), zero)}
    asked = right.select(F.explode(F.array(F.col(right_lo).cast("long"), F.col(right_hi).cast("long"))).alias("v")).distinct()
    steps = ends.groupBy("v").agg(*(c.alias(k) for k, c in sums.items())).unionByName(asked.select("v", *(zero.alias(k) for k in sums)))
    steps = steps.groupBy("v").agg(*(F.sum(k).alias(k) for k in sums))
    bounds = sorted(b for cell in cuts(steps.select(F.col("v").cast("double").alias("v")), max(2, side // 4)) for b in cell)
    ends_of = F.from_json(F.lit(json.dumps(bounds)), "array<double>")
    steps = steps.withColumn("cell", F.size(F.filter(ends_of, lambda b: b <= F.col("v"))))
    cells = steps.groupBy("cell").agg(*(F.sum(k).alias(k) for k in sums))  # a row a cell
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("cell", *(F.coalesce(F.sum(k).over(earlier), zero).alias(f"{k}_before") for k in sums))
    upto = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    known = steps.select("cell", "v", *(F.sum(k).over(upto).alias(k) for k in sums), *(F.col(k).alias(f"{k}_at") for k in ("a",))).join(F.broadcast(before), "cell")
    known = known.select("v", "a_at", *((F.col(k) + F.col(f"{k}_before")).alias(k) for k in sums))
    lo, hi = (known.select(*(F.col(c).alias(f"{x}_{c}") for c in known.columns)) for x in ("lo", "hi"))
    both = right.join(lo, F.col(right_lo).cast("long") == F.col("lo_v")).join(hi, F.col(right_hi).cast("long") == F.col("hi_v"))
    covered = lambda x: F.col(f"{x}_v") * (F.col(f"{x}_a") - F.col(f"{x}_b")) - F.col(f"{x}_sa") + F.col(f"{x}_sb")
    n = F.col("hi_a") - F.col("hi_a_at") - F.col("lo_b")
    return both.select(*right.columns, n.alias("n"), (covered("hi") - covered("lo")).alias("length")).where("n > 0")
