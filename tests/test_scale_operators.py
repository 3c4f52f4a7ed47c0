"""Overlap joins, ranks and grouped Python on hand-made rows, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from larkspan.functions import grouped
from larkspan.operators import overlap, ranks


def spans(seed, n):
    """Intervals from none to nearly the whole line, many with equal bounds."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        lo = r.randint(0, 300)
        out.append((i, lo, lo + r.choice([0, 1, 1, 2, 5, 40, 250, 1000, -3])))
    return [*out, (900, None, 5), (901, 5, None), (902, None, None), (903, -(10**6), 10**6), (904, 100, 101), (905, 100, 101)]


@pytest.mark.parametrize("side", [4, 64])
def test_totals_of_overlaps(spark, side):
    r = random.Random(side)
    spans = [(i, lo, lo + r.choice([0, 1, 3, 40, 900])) for i, lo in enumerate(r.randint(-500, 500) for _ in range(150))]
    left = spark.createDataFrame(spans, "i long, lo long, hi long")
    right = spark.createDataFrame(spans[::7] + [(999, 5_000, 5_010), (1_000, None, 3)], "j long, l2 long, h2 long")
    got = sorted(tuple(x) for x in overlap.totals(left, "lo", "hi", right, "l2", "h2", side=side).select("j", "n", "length").collect())
    both = [(j, min(hi, h2) - max(lo, l2)) for j, l2, h2 in spans[::7] for _, lo, hi in spans if max(lo, l2) < min(hi, h2)]
    assert got == sorted({j: (j, len(x := [n for k, n in both if k == j]), sum(x)) for j, _ in both}.values())
    plan = overlap.totals(left, "lo", "hi", right, "l2", "h2")._jdf.queryExecution().toString()
    assert "cell_big" not in plan  # pairs are not made
    assert overlap.totals(left.limit(0), "lo", "hi", right, "l2", "h2").count() == 0


@pytest.mark.parametrize("side", [2, 3, 8, 64])
def test_overlaps_come_once(spark, side):
    a, b = spans(1, 90), spans(2, 70)
    left = spark.createDataFrame(a, "i int, lo int, hi int").withColumns({"cell_big": F.lit("x"), "small": F.lit(1)})
    right = spark.createDataFrame(b, "j int, l2 int, h2 int")
    got = sorted((r["i"], r["j"]) for r in overlap.overlaps(left, "lo", "hi", right, "l2", "h2", side=side).collect())
    good = lambda rows: [x for x in rows if x[1] is not None and x[2] is not None and x[1] < x[2]]
    assert got == sorted((i, j) for i, p, q in good(a) for j, s, t in good(b) if p < t and s < q)


@pytest.mark.parametrize("side", [2, 64])
def test_points_in_spans(spark, side):
    r = random.Random(4)
    points = [(i, r.choice([0, 50, 50, r.randint(-5, 400)]) / 2) for i in range(120)] + [(500, None), (501, float("nan")), (502, float("inf"))]
    b = [(j, None if p is None else p / 2, None if q is None else q / 2) for j, p, q in spans(5, 60)]
    left = spark.createDataFrame(points, "i int, x double").withColumn("cell_small", F.lit(1))
    right = spark.createDataFrame(b, "j int, lo double, hi double")
    got = sorted((r["i"], r["j"]) for r in overlap.contains(left, "x", right, "lo", "hi", side=side).collect())
    assert got == sorted((i, j) for i, x in points for j, p, q in b if None not in (x, p, q) and p <= x < q)
    assert overlap.contains(left.limit(0), "x", right, "lo", "hi").count() == overlap.contains(left, "x", right.limit(0), "lo", "hi").count() == 0


def test_long_spans_are_few_rows(spark):
    """Each span is listed at most 3 * side times, whatever its length."""
    right = spark.range(400).select(F.col("id").alias("j"), F.col("id").alias("lo"), (F.col("id") + 10_000).alias("hi"))
    left = spark.range(10_400).select(F.col("id").alias("x"))
    plan = overlap.contains(left, "x", right, "lo", "hi", side=16)
    assert plan.count() == 400 * 10_000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("cells", [1, 3, 128])
def test_ranks_equal_windows(spark, cells):
    r = random.Random(cells)
    rows = [(r.choice(["big", "big", "big", "s", None]), r.choice([None, 1.0, 2.0, r.random()]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    got = {x["i"]: (x["row_no"], x["rank"], x["n"], x["tile"], x["share"]) for x in ranks.ranked(df, ["g"], "v", "i", cells).select("i", "row_no", "rank", "n", ranks.tile(7).alias("tile"), ranks.percent().alias("share")).collect()}
    df.createOrReplaceTempView("ranks_test")
    want = spark.sql("SELECT i, row_number() OVER (PARTITION BY g ORDER BY v, i) AS a, rank() OVER (PARTITION BY g ORDER BY v) AS b, count(*) OVER (PARTITION BY g) AS n, ntile(7) OVER (PARTITION BY g ORDER BY v, i) AS t, percent_rank() OVER (PARTITION BY g ORDER BY v) AS p FROM ranks_test").collect()
    assert got == {x["i"]: (x["a"], x["b"], x["n"], x["t"], x["p"]) for x in want}


def test_ranks_of_small_and_empty_tables(spark):
    one = spark.createDataFrame([(5.0, 1)], "v double, i int")
    assert [tuple(r) for r in ranks.ranked(one, [], "v", "i").select("row_no", "rank", "n", ranks.tile(4), ranks.percent()).collect()] == [(1, 1, 1, 1, 0.0)]
    assert ranks.ranked(one.limit(0), [], "v", "i").count() == 0


def test_no_cell_of_a_group_is_large(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"), F.col("id").alias("i"))
    placed = ranks.ranked(df, ["g"], "v", "i", cells=50)
    assert placed.agg(F.max("row_no")).head()[0] == 20_000
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "__cell" in plan


def test_regression_by_parts(spark):
    r = random.Random(3)
    rows = [("hot", float(x := r.uniform(0, 50) + 1e6), 3 * x - 7 + r.gauss(0, 1)) for _ in range(3000)] + [("a", 1.0, 2.0), ("a", 2.0, 4.5), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("none", None, 1.0), (None, 1.0, 5.0), (None, 3.0, 6.0), ("gap", 1.0, None), ("gap", 2.0, 1.0), ("gap", 4.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").withColumns({"n": F.lit(1), "k": F.lit("x"), "part": F.lit(0)})
    want = {g: (n, s, i) for g, n, s, i in df.groupBy("g").agg(F.regr_count("y", "x"), F.regr_slope("y", "x"), F.regr_intercept("y", "x")).collect()}
    for size in (100, 50_000):
        got = {r["g"]: (r["n"], r["slope"], r["intercept"]) for r in grouped.regression(df, "g", "x", "y", rows=size).collect()}
        assert set(got) == set(want)
        for g, (n, slope, intercept) in want.items():
            assert got[g][0] == n
            for a, b in ((got[g][1], slope), (got[g][2], intercept)):
                assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-4 * max(1, abs(b)))


def test_parts_are_bounded(spark):
    seen = spark.sparkContext.accumulator(0)

    def part(rows):
        seen.add(1)
        assert rows.num_rows <= 1300
        return {"n": rows.num_rows}

    df = spark.range(10_000).select(F.when(F.col("id") < 9_990, "hot").otherwise("cold").alias("g"), F.lit(1.0).alias("x"))
    found = grouped.by_parts(df, "g", ["x"], part, ["n"], {"n": F.sum("n")}, rows=1000)
    assert {r["g"]: r["n"] for r in found.collect()} == {"hot": 9990.0, "cold": 10.0} and seen.value >= 10
