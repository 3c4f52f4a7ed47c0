"""op11 against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from larkspan.llm import hard_negatives
from larkspan.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, step, top=5, floor=80):
    """(anchor, positive, rank, negative, positive score, negative score); rows are (id, vector, label)."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        if sum(x * x for x in w) < 1 << 60:
            good[i] = min(good.get(i, (label, w)), (label, w))
    out = []
    for i, (label, v) in good.items():
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, (m, w) in good.items() if j != i)
        for p, j, m in [x for x in scored if x[2] == label][:top]:
            fits = [(n, k) for n, k, m in scored if m != label and floor * -p <= 100 * -n <= 100 * -p]
            out += [(i, j, r, k, -p, -n) for r, (n, k) in enumerate(fits[:top], 1)]
    return sorted(out)


def mined(spark, rows, step, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "g": F.lit("x"), "LABELS": F.lit(2)})
    work = Scratch(spark, "test")
    table = hard_negatives.vectors(df, "vec_id", F.col("label"), "embedding", 256.0, work)
    return sorted(tuple(r) for r in hard_negatives.mine(table, F.col("id") % step == 0, work, **options).collect())


def some(n, labels, seed, d=5):
    """Small integers in 256ths, so that there are many ties; one label has a third of the rows."""
    r = random.Random(seed)
    return [(i, [r.randint(-2, 4) / 256 for _ in range(d)], 0 if i % 3 == 0 else r.randrange(labels)) for i in range(n)]


ODD = [(None, [1.0], 1), (900, None, 1), (901, [1.0, None], 1), (902, [float("nan"), 1.0], 0), (903, [float("inf")], 0), (904, [1.0, 2.0], None), (905, [1e300], 1), (906, [], 1), (907, [0.5], 0), (909, [0.01] * 9, 1), (0, [0.3, 0.1], 0), (0, [0.3, 0.1], 0), (3, [0.5, 0.5], 2), (-4, [0.25, 0.5], 1), (910, [3e6, 1.0], 1), (912, [3e6, 0.5], 1), (913, [2.9e6, 0.0], 0)]


@pytest.mark.parametrize("rows", [some(70, 3, 1), some(60, 2, 2) + ODD, ODD, some(40, 40, 3)])
def test_equals_brute_force_in_small_tiles(spark, monkeypatch, rows):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "ROWS", 8)
    monkeypatch.setattr(hard_negatives, "WIDTH", 2)
    want = brute(rows, 4)
    assert mined(spark, rows, 4) == want


def test_other_window_and_number(spark):
    rows = some(80, 4, 5)
    assert mined(spark, rows, 10, top=3, floor=50) == brute(rows, 10, 3, 50) != []


def test_long_vectors_have_at_most_eight_chunks(spark):
    r = random.Random(7)
    rows = [(i, [r.uniform(-1, 1) for _ in range(600)], i % 2) for i in range(24)]
    assert mined(spark, rows, 4, floor=1) == brute(rows, 4, 5, 1)


def test_empty_tables(spark):
    assert mined(spark, [], 2) == []
    assert mined(spark, [(1, [1.0], 1)], 2) == []
    assert mined(spark, [(2, [1.0], 1)], 2) == []
    assert mined(spark, [(2, [], 1), (4, [], 1), (5, [], 2)], 2) == brute([(2, [], 1), (4, [], 1), (5, [], 2)], 2)
