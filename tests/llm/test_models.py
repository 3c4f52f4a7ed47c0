"""op2, op3, op5 and op6: held-out accuracy, brute force and edge cases."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import docstats, language_id, lm_score, quality_model, quality_rules
from larkspan.llm.queries_c import remainder


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_language_held_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = language_id.identify(docs, remainder(4) != 2).join(docs, "doc_id").where(remainder(4) == 2).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, frame):
    docs = frame([None, "", "123 $$", "hello there friend", "a b", "x" * 5000])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, F.lit(True)).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    assert got[3][0] == "en"
    assert {r["lang_pred"] for r in language_id.identify(docs, F.lit(False)).collect()} == {"und"}
    assert language_id.identify(frame([]), F.lit(True)).count() == 0


def test_language_probabilities_sum_to_one():
    model = language_id.fit({"x": ["abab baab abba", "aabb"] * 30, "y": ["cdcd ddcc"] * 30})
    for context in ("ab", "ba", "zz"):
        total = np.zeros(2)
        for c in "abcd ":
            codes = np.array([ord(v) for v in f"  {context}{c}"], np.uint64)
            keys = language_id.gram_keys(codes, model.order)
            total += np.exp(model.log_probs(keys, np.array([len(codes) - 1]), model.order))[0]
        assert (total < 1.001).all()
        assert total.max() > 0.8


def test_quality_held_out(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # 0.001 has too few labels to learn from
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = quality_model.score(docs, labels, remainder(3) != 1).join(labels, "doc_id").where(remainder(3) == 1).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in got]) > 0.9
    kept = quality_model.keep_good(docs, labels, remainder(3) != 1)
    assert kept.columns == docs.columns
    assert 0.7 * docs.count() < kept.count() < docs.count()


def test_quality_edges(spark, frame):
    docs = frame([None, "", "some text here", "x " * 20000])
    labels = spark.createDataFrame([(1, 1), (None, 0), (99, 0), (2, None)], "doc_id long, quality int")
    got = quality_model.score(docs, labels, F.lit(True)).collect()
    assert len(got) == 4
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality_model.score(docs, labels.where("false"), F.lit(True)).count() == 4
    assert quality_model.score(frame([]), labels, F.lit(True)).count() == 0


def test_trees_learn_and_are_deterministic():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, len(docstats.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    a, b = quality_model.fit(x, y), quality_model.fit(x, y)
    assert ((a.score(x) > 0.5) == y).mean() > 0.97
    assert (a.score(x) == b.score(x)).all()


def test_rules_base_counts(spark, frame, corpus):
    texts = [*corpus, "dup line\ndup line\n \ndup line\nother | * line #", "a b c d e a b c d e f g h i"]
    labels = spark.createDataFrame([(i, 1) for i in range(10, 30)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.verdicts(frame(texts), labels).collect()}
    for i, text in enumerate(texts):
        w = words(text)
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = set()
        for k in range(len(w) - 4):
            if grams[tuple(w[k : k + 5])] > 1:
                again |= set(range(k, k + 5))
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_rules_ratio_and_threshold_by_brute_force(spark, frame, corpus):
    import pyarrow as pa

    from larkspan.llm import arrays

    texts = [*corpus, corpus[9]]
    good = {i for i in range(8, 30)}
    labels = spark.createDataFrame([(i, 1) for i in good] + [(40, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.verdicts(frame(texts), labels).collect()}
    grams = []
    for t in texts:
        (chunk,) = arrays.chunks([pa.RecordBatch.from_pydict({"text": pa.array([t], pa.string())})])
        grams.append(quality_rules._buckets(docstats.Stats(chunk))[0].tolist())
    raw = collections.Counter(b for g in grams for b in g)
    target = collections.Counter(b for i, g in enumerate(grams) if i in good for b in g)
    n_raw, n_target = (sum(c.values()) + quality_rules.BUCKETS for c in (raw, target))
    ratio = {b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in raw}
    llr = [sum(ratio[b] for b in g) / max(len(g), 1) for g in grams]
    for i in range(len(texts)):
        assert got[i]["llr"] == pytest.approx(llr[i], abs=1e-9)
    trusted = [llr[i] for i in good if not got[i]["base_failed"]]
    middle = float(np.median(trusted))
    threshold = middle - quality_rules.SPREAD * max(float(np.median(np.abs(np.array(trusted) - middle))), 1e-3)
    for i in range(len(texts)):
        assert got[i]["threshold"] == pytest.approx(threshold, abs=1e-9)
        assert got[i]["kept"] == (not got[i]["base_failed"] and llr[i] >= threshold - 1e-12)


def test_rules_trust_every_good_document(spark):
    docs = spark.range(41_000).selectExpr("id AS doc_id", "concat('w', id % 97, ' a b c d e f g h i j') AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    assert quality_rules.scored(docs, labels).where("trusted").count() == 41_000


@pytest.mark.parametrize("n", [1, 2, 999, 1000])
def test_rules_median(spark, n):
    r = np.random.default_rng(n)
    values = np.r_[np.round(r.normal(size=n), 2), 1e9, 1e-9][:n]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert quality_rules.median(rows, F.col("v"), cells=7, few=3) == pytest.approx(float(np.median(values)), abs=1e-12)
    assert quality_rules.median(rows.where("v IS NULL"), F.col("v")) is None


def test_rules_without_target_or_rows(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.verdicts(frame(["a b c d e f g h i j k", None]), none).collect()
    assert sorted((r["kept"], r["llr"]) for r in got) == [(False, 0.0), (True, 0.0)]
    assert quality_rules.verdicts(frame([]), none).count() == 0


def test_rules_separate_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    got = quality_rules.verdicts(table(spark, sf_dir, "documents"), labels).where("NOT base_failed").join(labels, "doc_id").collect()
    assert np.mean([r["kept"] for r in got if r["quality"] == 1]) > 0.95


def brute_lm(texts, train):
    tokens = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)] + [None] for t in texts]
    counts = collections.Counter(w for t, ok in zip(tokens, train, strict=True) if ok for w in t)
    total, distinct = sum(counts.values()), len(counts)
    return [(len(t), sum(counts[w] > 0 for w in t), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)) for t in tokens]


@pytest.mark.parametrize("top", [lm_score.TOP, 20])
def test_lm_base_scores(spark, frame, corpus, monkeypatch, top):
    monkeypatch.setattr(lm_score, "TOP", top)  # most tokens then meet their counts in the join
    docs = frame(corpus + corpus[7:9], [*range(len(corpus)), 7, 8])
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm_score.score(docs, F.col("doc_id") % 3 != 0).collect())
    ids = [*range(len(corpus)), 7, 8]
    want = brute_lm(corpus + corpus[7:9], [i % 3 != 0 for i in ids])
    assert got == sorted((i, *w[:3], round(w[3], 6)) for i, w in zip(ids, want, strict=True))


def test_lm_beats_its_base_on_held_out_text(spark, sf_dir):
    got = lm_score.score(table(spark, sf_dir, "documents"), remainder(7) != 2).where(remainder(7) == 2).agg(F.sum("base_score"), F.sum("score")).head()
    assert got[1] > got[0]


def test_lm_edges(frame):
    got = lm_score.score(frame([None, "", "a"]), F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert lm_score.score(frame([]), F.lit(True)).count() == 0


def test_log_filter_recalls_levels():
    import pyarrow as pa

    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 30_000).astype(np.uint64)
    counts = r.integers(1, 200, 30_000)
    shape = lm_score._shape(200_000)
    q, segment = lm_score.level(counts), shape.segment(keys)
    data = np.zeros(shape.segments * shape.width // 8, np.uint8)
    for k in range(shape.segments):
        short = (keys[segment == k] & lm_score._SHORT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
        rows = pa.table({"segment": [k], "once": [b""], "more": [short], "counts": [counts[segment == k].astype("<i8").tobytes()]})
        data[k * shape.width // 8 : (k + 1) * shape.width // 8] = np.frombuffer(lm_score._build(shape)((pa.scalar(k),), rows)["data"][0].as_py(), np.uint8)
    found = lm_score.LogFilter(shape.segments, shape.width, data).levels(keys)
    assert (found >= q).all()
    assert (found == q).mean() > 0.97
    strange = lm_score.LogFilter(shape.segments, shape.width, data).levels(r.integers(0, 1 << 63, 30_000).astype(np.uint64))
    assert (strange > 0).mean() < 0.03


def brute_model(texts, train):
    """The bigram model with exact dictionaries; frequent tokens have exact counts."""
    tokens = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)] + [None] for t in texts]
    learnt = [t for t, ok in zip(tokens, train, strict=True) if ok]
    single = collections.Counter(w for t in learnt for w in t)
    pairs = collections.Counter(p for t in learnt for p in zip(["<"] + t[:-1], t, strict=True))
    total, distinct = sum(single.values()), len(single)
    single["<"] = len(learnt)

    def log(v, w):
        n = pairs[v, w]
        n = min(n if n < 2 else 0.75 * 2 ** (int(math.log2(n)) + 1), single[v])
        return math.log10((n + lm_score.PRIOR * (single[w] + 1) / (total + distinct + 1)) / (single[v] + lm_score.PRIOR))

    return [sum(log(v, w) for v, w in zip(["<"] + t[:-1], t, strict=True)) for t in tokens]


def test_probes_are_sent_once_for_a_chunk_of_texts():
    """Texts that repeat their pairs send few bytes to the segments, however often they occur."""
    import pyarrow as pa

    texts = [" ".join(f"w{(k * j) % 50}" for k in range(400)) for j in range(1, 60)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    (chunk,) = lm_score.A.chunks([batch])
    keys, doc = lm_score.tokens(chunk)
    pair, alone, _ = lm_score.ngrams(keys, doc)
    top, shape = lm_score.Top(np.zeros(0, np.uint64), np.zeros(0, np.int64)), lm_score._shape(20 << 20)
    names, sent = lm_score._questions(chunk, top, shape)
    different = len(np.unique(np.r_[pair, alone]))
    assert sum(map(len, sent)) == 5 * different < len(keys) and sorted(set(names)) == list(names)


def test_lm_scores_are_the_same_by_segments(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm_score, "SEGMENT_TOKENS", 3_000)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(spark.createDataFrame([(None, None), (-1, "")], "doc_id long, text string"))
    found = [sorted(map(str, lm_score.score(docs, remainder(7) != 2, max_filter=limit).collect())) for limit in (lm_score.MAX_FILTER, 0)]
    assert found[0] == found[1] and len(found[0]) == docs.count()


@pytest.mark.parametrize("limit", [lm_score.MAX_FILTER, 0])
def test_lm_scores_against_exact_counts(frame, corpus, monkeypatch, limit):
    monkeypatch.setattr(lm_score, "SEGMENT_TOKENS", 700)  # several segments
    monkeypatch.setattr(lm_score, "KEY_BITS", 64)  # levels that pass by chance are rare
    ids = [*range(len(corpus)), 7, None]
    texts = [*corpus, corpus[7], corpus[30]]
    docs = frame(texts, ids)
    got = lm_score.score(docs, F.col("doc_id") % 3 != 0, max_filter=limit).collect()
    want = brute_model(texts, [i is not None and i % 3 != 0 for i in ids])
    key = lambda x: (x[0] is None, x[0] or 0)
    got, want = sorted(((r["doc_id"], r["score"]) for r in got), key=key), sorted(zip(ids, want, strict=True), key=key)
    assert [i for i, _ in got] == [i for i, _ in want]
    close = [abs(x - y) <= 1e-9 * max(1, abs(y)) for (_, x), (_, y) in zip(got, want, strict=True)]
    assert np.mean(close) > 0.9
    assert all(abs(x - y) < 0.05 * max(1, abs(y)) for (_, x), (_, y) in zip(got, want, strict=True))


def brute_kneser_ney(texts, order):
    """Interpolated Kneser-Ney with dictionaries: {n-gram: P} and {context: weight} for each order."""
    folded = [" " + "".join(c if c.isalpha() else " " for c in t.lower()) for t in texts]
    folded = [re.sub(" +", " ", t) for t in folded]
    counts = [collections.Counter(t[i - n + 1 : i + 1] for t in folded for i in range(max(n - 1, 1), len(t))) for n in range(1, order + 1)]
    probs, weights = [], []
    for n in range(1, order + 1):
        c = counts[n - 1]
        if n < order:
            tails = collections.Counter(g[1:] for g in counts[n])
            c = {g: tails.get(g, 0) or 1 for g in c}
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
        total, kinds = collections.Counter(), collections.Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        weights.append({x: d * kinds[x] / total[x] for x in total})
        probs.append({g: (v - d) / total[g[:-1]] + weights[-1][g[:-1]] * (probs[-1][g[1:]] if n > 1 else 1 / (len(c) + 1)) for g, v in c.items()})
    return probs, weights


def test_language_model_equals_dictionaries():
    import random

    r = random.Random(2)
    texts = {x: ["".join(r.choice(letters) for _ in range(r.randint(3, 60))) for _ in range(40)] for x, letters in (("x", "aab c"), ("y", "bcdd É1"))}
    model = language_id.fit(texts, order=3)
    for j, x in enumerate(sorted(texts)):
        learnt = [t for t in texts[x] if any(map(str.isalpha, t))]
        learnt = [t for i, t in enumerate(learnt) if i % language_id.HELD_SHARE]
        probs, weights = brute_kneser_ney(learnt, 3)
        floor = weights[0][""] * language_id._UNSEEN

        def p(g):
            if g in probs[len(g) - 1]:
                return probs[len(g) - 1][g]
            return weights[len(g) - 1].get(g[:-1], 1.0) * p(g[1:]) if len(g) > 1 else floor

        for g in ["abc", "aaa", "cab", " ab", "b c", "ddé", "éd ", "xyz", "dxb", "abx", "a", " a", "zz"]:
            codes = np.array([ord(c) for c in g], np.uint64)
            got = model.log_probs(language_id.gram_keys(codes, 3), np.array([len(g) - 1]), len(g))[0, j]
            assert got == pytest.approx(math.log(p(g)), abs=2e-3), (x, g)


def test_language_of_long_texts_and_many_languages(spark):
    long = {"aa": "aba bab " * 40_000, "bb": "cdc dcd " * 10}
    docs = spark.createDataFrame([(i, long[x], x) for i, x in enumerate(long)] + [(9, None, "cc"), (10, "12 3", "dd")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, F.lit(True), max_chars=50_000).collect()}
    assert got == {0: "aa", 1: "bb", 9: "und", 10: "und"}
    model = language_id.train(docs, F.lit(True), max_chars=50_000, max_total=60_000)
    assert model.langs == ["aa", "bb"]


def test_quality_training_rows_do_not_depend_on_row_order(spark, frame, monkeypatch):
    monkeypatch.setattr(quality_model, "fit", lambda x, y: (x.tolist(), y.tolist()))
    docs = frame([f"text {'long ' * k}end" for k in range(60)], [k % 3 for k in range(60)])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    got = []
    for order in (F.asc("text"), F.desc("text")):
        rows = docs.coalesce(1).sortWithinPartitions(order)
        got.append(quality_model.train(quality_model.statistics(rows), labels, F.lit(True), max_rows=4))
    assert got[0] == got[1]
    assert len(got[0][1]) == 8


def test_one_tree_against_a_direct_search():
    """Every split is the best of all cuts of all features, by plain sums over the node's rows."""
    r = np.random.default_rng(4)
    x = r.integers(0, 40, size=(400, 5)).astype(np.float32)
    y = ((x[:, 1] + x[:, 3] > 40) ^ (r.random(400) < 0.1)).astype(float)
    model = quality_model.fit(x, y, trees=1)
    share = (y.sum() + 1) / (len(y) + 2)
    g, h = y - share, np.full(len(y), share * (1 - share))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_model.BINS + 1)[1:-1])) for f in range(5)]

    def gain(rows, f, c):
        left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
        if min(h[left].sum(), h[right].sum()) < quality_model.LEAST_WEIGHT:
            return -1.0
        part = lambda k: g[k].sum() ** 2 / (h[k].sum() + quality_model.RIDGE)
        return part(left) + part(right) - part(rows)

    def check(node, rows):
        if node >= 2**quality_model.DEPTH - 1:
            want = quality_model.RATE * g[rows].sum() / (h[rows].sum() + quality_model.RIDGE)
            assert model.leaf[0][node - (2**quality_model.DEPTH - 1)] == pytest.approx(want, abs=1e-9)
            return
        best = max((gain(rows, f, c) for f in range(5) for c in cuts[f]), default=-1.0)
        f, c = int(model.feature[0][node]), model.cut[0][node]
        if np.isinf(c):
            assert best <= 1e-6 + 1e-9
        else:
            assert gain(rows, f, c) == pytest.approx(best, rel=1e-6)
        check(2 * node + 1, rows[x[rows, f] <= c])
        check(2 * node + 2, rows[x[rows, f] > c])

    check(0, np.arange(len(x)))


def test_labels_of_one_document_count_once(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, quality_model.sampled(labels, F.lit(True)).collect())) == [(1, 1), (3, 0)]


def test_very_long_texts(spark, frame):
    import random

    from larkspan.llm import near_dedup, substring_dedup

    r = random.Random(8)
    vocab = [f"word{i}" for i in range(5000)]
    long = " ".join(r.choice(vocab) for _ in range(400_000))  # 3.5 MB
    docs = frame([long, "short text here", long + " end"])
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert language_id.identify(docs, F.lit(True)).count() == 3
    assert quality_model.score(docs, labels, F.lit(True)).count() == 3
    assert sorted(x["n_tokens"] for x in lm_score.score(docs, F.lit(True)).collect()) == [4, 400_001, 400_002]
    assert sorted(x["n_words"] for x in quality_rules.verdicts(docs, labels).collect()) == [3, 400_000, 400_001]
    assert sorted((x["doc_id"], x["n_removed"]) for x in substring_dedup.dedup(docs).collect()) == [(0, 0), (1, 0), (2, 400_000)]
    assert {x["ord"]: x["class_id"] for x in near_dedup.classes(docs).collect()} == {0: 0, 1: 1, 2: 0}


def test_language_fit_holds_one_language_at_a_time():
    import tracemalloc

    text = " ".join(f"word{chr(97 + i % 7)}{chr(97 + i % 11)}" for i in range(20_000))

    def peak(n):
        tracemalloc.start()
        language_id.fit({f"x{i}": [text, text] for i in range(n)})
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    peak(1)  # tables that are made once
    assert peak(8) < 1.5 * peak(1)
