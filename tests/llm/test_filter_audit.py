"""op13 against brute force over hand-made rows."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from larkspan.llm import filter_audit


def brute(docs, labels):
    """part, order, step -> counts; docs are (doc_id, text, lang), labels (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, text, _ in docs:
        least[text or ""] = min(least.get(text or "", float("inf")), float("inf") if i is None else i)
    failed = []
    for i, text, lang in docs:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        f |= {"E"} if (float("inf") if i is None else i) > least[text] else set()
        failed.append((lang or "", f, i in good, i in toxic))
    out, total = {}, {}
    for part in {x[0] for x in failed}:
        mine = [x[1:] for x in failed if x[0] == part]
        for order in permutations("ABCDE"):
            for step, k in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [x for x in mine if k in x[0] and not x[0] & before]
                kept = sum(not x[0] & (before | {k}) for x in mine)
                again = sum(k in x[0] and bool(x[0] & before) for x in mine)
                only = sum(x[0] == {k} for x in mine)
                out[part, "".join(order), step] = (kept, len(gone), again, only, sum(x[1] for x in gone), sum(x[2] for x in gone))
                total[part, k] = total.get((part, k), 0) + len(gone)
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


LONG = " ".join(f"w{i}" for i in range(200))
TEXTS = [None, "", " \t\n", LONG, LONG, LONG + " $", "a b", "A B", "a " * 400, LONG.upper(), LONG.upper() + "#", "é|" * 3, "one\x0btwo three", LONG[:-1], "x" * 300_000, "a b"]
DOCS = [(i, t, ("en", "", None, "de")[i % 4]) for i, t in enumerate(TEXTS)]
MORE = [(None, "a b", "en"), (None, "a b", "en"), (None, "only null", "fr"), (5, TEXTS[5], "en"), (5, TEXTS[5], "de"), (5, "another", "de"), (-7, LONG, "de"), (-7, LONG, "de")]
LABELS = [(0, 1, 0), (1, 1, 1), (3, 1, 0), (3, 0, 1), (4, 1, None), (5, 1, 1), (5, 1, 1), (9, None, 1), (None, 1, 1), (-7, 1, 1)]


@pytest.mark.parametrize("docs", [DOCS, DOCS + MORE, DOCS[:1], MORE * 30])
def test_audit_equals_brute_force(spark, docs):
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"part": F.lit("x"), "n": F.lit(3), "FP": F.lit(1), "good": F.lit(1)})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("y"))
    assert got(filter_audit.audit(table, labels)) == brute(docs, LABELS)


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(filter_audit.audit(docs, labels)) == brute(DOCS, [])
    assert filter_audit.audit(docs.limit(0), labels).count() == 0


def test_every_set_is_in_the_lattice(spark):
    flagged = spark.createDataFrame([("p", True, False, False, False, True, 3, 1, 0)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, n long, good long, toxic long")
    rows = {r["subset"]: r["n"] for r in filter_audit.lattice(filter_audit.survivors(flagged)).collect()}
    assert rows == {s: 0 if s & 17 else 3 for s in range(32)}
