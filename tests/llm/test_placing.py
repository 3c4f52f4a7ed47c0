"""op4, op7 and op9, and the pipeline."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from larkspan.llm import decontaminate, packing, sharding


def norm(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute_hits(docs, items):
    out = []
    for text in docs:
        w, hit, who = norm(text), set(), set()
        for item, t in items:
            b = norm(t)
            size = min(10, len(b))
            grams = {tuple(b[k : k + size]) for k in range(max(1, len(b) - 9))} if b else set()
            for k in range(len(w) - size + 1 if b else 0):
                if tuple(w[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    who |= {str(item)} if item is not None else set()
        out.append((len(w), len(hit), sorted(who)))
    return out


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_WINDOWS, 0])
def test_decontamination(spark, frame, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", limit)
    long = " ".join(f"q{k}" for k in range(25))
    items = [(1, long), (2, "Short ITEM ünï"), (3, None), (4, "..."), (None, "ghost words"), (10, long), (5, "solo")]
    docs = [None, "", "nothing here", f"x {long.upper()}, y", "a short-item ünï b", " ".join(long.split()[3:14]), "SOLO", "ghost words", "z " * 3000 + long]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.report(frame(docs), bench).collect()}
    assert [got[i] for i in range(len(docs))] == brute_hits(docs, items)
    kept = decontaminate.drop_contaminated(frame(docs), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, w in enumerate(brute_hits(docs, items)) if not w[1]]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(frame(docs), bench).collect()}
    assert (cut[3], cut[4], cut[2]) == ("x y", "a b", "nothing here")


def test_decontamination_of_nothing(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(frame([]), none).count() == 0
    assert [r["contaminated"] for r in decontaminate.report(frame(["a b"]), none).collect()] == [False]


def test_shards(frame, corpus):
    ids = [None if k % 20 == 0 else k // 2 for k in range(len(corpus))]
    got = sharding.shard_documents(frame(corpus, ids)).collect()
    slots = collections.defaultdict(list)
    place = {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["rack"] == r["shard"] // 4
        assert r["region"] == r["shard"] // 8
        assert place.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = sorted((r["size"], r["text_crc32"]) for r in got)
    assert sizes == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in corpus)
    assert sharding.shard_documents(frame([])).count() == 0


def brute_place(doc_id, leaves):
    """The descent in plain Python: the least weighted draw at each level."""
    import math
    import struct

    import xxhash

    def draw(level, node, weight):
        h = xxhash.xxh64_intdigest(("" if doc_id is None else str(doc_id)).encode(), 42)
        for x in (level, node):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), h)
        return -math.log(((h >> 11) + 0.5) / 2.0**53) / weight if weight > 0 else math.inf

    def least(level, nodes, weight):
        return min(nodes, key=lambda n: draw(level, n, weight(n)))

    shards = len(leaves)
    region = least(0, range(-(-shards // 8)), lambda n: sum(leaves[8 * n : 8 * n + 8]))
    rack = least(1, range(2 * region, 2 * region + 2), lambda n: sum(leaves[4 * n : 4 * n + 4]))
    return region, rack, least(2, range(4 * rack, 4 * rack + 4), lambda n: leaves[n] if n < shards else 0)


@pytest.mark.parametrize(("shards", "weights"), [(24, {}), (25, {}), (24, {5: 3.5, 0: 0.0, 9: 0.25}), (1, {}), (7, {6: 9.0})])
def test_places_are_those_of_a_plain_descent(spark, shards, weights):
    docs = spark.createDataFrame([(None,), *((k,) for k in range(-3, 600))], "doc_id long")
    leaves = [weights.get(i, 1.0) for i in range(shards)]
    for r in sharding.place(docs, shards, weights).collect():
        assert (r["region"], r["rack"], r["shard"]) == brute_place(r["doc_id"], leaves)


def test_weights_move_rows_only_out_of_or_into_their_subtree(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")
    even = sharding.place(docs, 24)
    counts = [r["count"] for r in even.groupBy("shard").count().collect()]
    assert len(counts) == 24
    assert max(counts) < 1.25 * min(counts)
    # A region that grows takes rows from the others, and its other rows move only into the heavier child.
    moved = sharding.place(even, 24, {5: 2.0}, prefix="new_").where("shard <> new_shard").collect()
    assert {r["new_region"] for r in moved} == {0}
    assert {r["new_rack"] for r in moved if r["region"] == 0 and r["rack"] != r["new_rack"]} == {1}
    assert {r["new_shard"] for r in moved if r["rack"] == 1} == {5}
    # A region that shrinks only gives rows.
    moved = sharding.place(even, 24, {5: 0.0}, prefix="new_").where("shard <> new_shard").collect()
    assert {r["region"] for r in moved} == {0}
    # Weights that change places in a rack leave all else where it was.
    moved = sharding.place(even, 24, {4: 1.5, 5: 0.5}, prefix="new_").where("shard <> new_shard").collect()
    assert {(r["rack"], r["new_rack"]) for r in moved} == {(1, 1)}
    # One more shard takes rows only into itself.
    moved = sharding.place(even, 25, prefix="new_").where("shard <> new_shard").collect()
    assert {r["new_shard"] for r in moved} == {24}
    assert 0.8 < len(moved) / (20_000 / 25) < 1.2
    with pytest.raises(ValueError, match="weights"):
        sharding.place(docs, 2, {0: 0.0, 1: 0.0})


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(0)
    for sizes in (range(1, 129), range(40, 60), [128], [1]):
        left = {int(s): int(r.integers(1, 400)) for s in sizes}
        total = sum(s * n for s, n in left.items())
        used, count = collections.Counter(), 0
        for pattern, times in packing.plan(left, 128):
            assert sum(s * k for s, k in pattern.items()) <= 128
            count += times
            for s, k in pattern.items():
                used[s] += k * times
        assert used == left
        if len(left) > 100:
            assert count * 128 < 1.03 * total
    assert packing.plan({}, 128) == []


def test_column_generation_beats_the_first_basis():
    sizes, demand = np.array([34, 35, 45, 60]), np.array([300.0, 300.0, 300.0, 300.0])
    first = packing._start(sizes, demand, 128)[1].sum()
    solved = packing.generate(sizes, demand, 128)
    assert solved.priced > 0
    assert solved.uses[solved.is_pattern].sum() < first
    # No pattern at all improves: the optimum of all patterns, listed one by one.
    held = np.stack(solved.columns, 1) @ solved.uses
    assert np.allclose(held, demand)
    patterns = [(a, b, c, d) for a in range(4) for b in range(4) for c in range(3) for d in range(3) if 34 * a + 35 * b + 45 * c + 60 * d <= 128]
    cost = np.where(solved.is_pattern, 1.0, 0.0)
    duals = np.linalg.solve(np.stack(solved.columns, 1).astype(float).T, cost)
    assert max(np.dot(p, duals) for p in patterns) <= 1 + packing.GAP + 1e-9


def test_patterns_are_priced_on_documents(spark):
    """First-fit does not end the search on a real histogram."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    paths, left = packing.default_vocabulary(), collections.Counter()
    for t in texts:
        n = len(packing.encode(t or "", paths)) + 1
        left.update([packing.LENGTH // packing.GRID] * (n // packing.LENGTH) + [-(-(n % packing.LENGTH) // packing.GRID)] * (n % packing.LENGTH > 0))
    sizes = np.array(sorted(s for s in left if s < packing.LENGTH // packing.GRID))
    found = packing.generate(sizes, np.array([float(left[int(s)]) for s in sizes]), packing.LENGTH // packing.GRID)
    assert found.priced > 0


def test_fast_tokens_equal_the_tokenizers(spark):
    """Every document of sf0.1, and text made to differ: all code points beside letters, digits and spaces."""
    slow, _ = packing._encoders(*packing.default_vocabulary())
    paths = packing.default_vocabulary()
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{c}1 {c}{c} " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    texts += ["", " ", "  \n\t x", "it's  they'LL 'S", "a\u0085b\u2028c\u3000 d", "\r\n\r\n", "x" * 3000, " " * 500 + "y", "<|endoftext|>", "a<|endoftext|> b", "<|endoftext"]
    wrong = [t for t, e in zip(texts, slow.encode_batch(texts, add_special_tokens=False), strict=True) if packing.encode(t, paths) != e.ids]
    assert wrong == []


def test_packing_round_trip(frame, corpus):
    from tokenizers import Tokenizer

    texts = [*corpus, "text with <|endoftext|> inside", "long " * 5000]
    rows = packing.pack(frame(texts)).collect()
    vocabulary = Tokenizer.from_file(packing.default_vocabulary()[0])
    pieces, room = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids, at = [*vocabulary.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(frame([])).count() == 0


def test_packing_does_not_depend_on_the_order_of_rows(frame, corpus):
    docs = frame([*corpus, corpus[20]], [*range(len(corpus)), 20])
    got = [sorted((tuple(-1 if x is None else x for x in r) for r in packing.pack(d).collect())) for d in (docs, docs.repartition(3, "text").sortWithinPartitions("text"))]
    assert got[0] == got[1]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, columns = docs.count(), docs.columns
    work = corpus_pipeline.Scratch(spark, "test-pipeline")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == columns
        assert 0.7 * kept < docs.count() <= kept
        kept = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert out.select("doc_id").distinct().count() == kept


@pytest.fixture
def odd_dir(spark, frame, corpus, tmp_path):
    """Tables with nulls, ties, repeated rows and columns whose names operators use."""
    texts = [*corpus, None, "", corpus[20], corpus[20]]
    docs = frame(texts, [*range(len(corpus)), None, None, 20, 20])
    docs = docs.selectExpr("*", "1 AS __key0", "2 AS __kept", "3 AS __label_id", "'m' AS __mask", "4 AS comp", "5 AS id", "6 AS words")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(20)] + [(3, None), (None, 1), (5, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, corpus[-1]), (2, None), (None, "changed"), (1, corpus[-1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_each_stage_with_odd_rows_and_empty_tables(spark, odd_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        last = stage is corpus_pipeline.STAGES[-1][1]
        out = stage(spark, docs, odd_dir)
        rows = out.collect()
        assert rows
        assert last or out.columns == docs.columns
        assert last or all((r["__key0"], r["__kept"], r["comp"], r["words"]) == (1, 2, 4, 6) for r in rows)
        assert stage(spark, docs.limit(0), odd_dir).count() == 0
    lines = corpus_pipeline.lines(spark, docs, odd_dir)
    assert lines.where("text IS NULL").count() == docs.where("text IS NULL").count()
    near = corpus_pipeline.near_duplicates(spark, docs, odd_dir)
    assert near.where("doc_id = 20").count() == 1
    assert near.where("text IS NULL OR text = ''").count() == 1
    clean = corpus_pipeline.decontamination(spark, docs, odd_dir)
    assert clean.where("text LIKE '%changed%'").count() == 0
    assert clean.where("text IS NULL").count() == docs.where("text IS NULL").count()


def test_near_duplicates_by_what_line_dedup_left_and_by_what_was_there(spark, frame, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    line = lambda n: " ".join(f"w{r.randint(0, 10_000)}" for _ in range(n))
    left = line(60)
    alike = left.replace(" ", "\n", 1) + " more"  # 1 and 2 are alike by what is left alone
    one, two, three = line(60), line(12), line(12)  # 3 and 4 by what was there alone
    near_before = [f"{one}\n{two}", f"{one}\n{three}"]
    whole = [f"{line(100)}\n{left}", f"{line(100)}\n{alike}", *near_before, line(50)]
    frame(whole, range(1, 6)).write.parquet(str(tmp_path / "documents.parquet"))
    docs = frame([left, alike, near_before[0], three, whole[4]], range(1, 6))
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(x["doc_id"] for x in out.collect()) == [1, 3, 5]


def near_pairs(texts):
    """Pairs of texts at a word edit similarity of 0.8: every pair that shares a run of four words is aligned."""
    from larkspan.llm.near_dedup import banded_distance

    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    index, pairs = collections.defaultdict(list), set()
    for i, w in enumerate(split):
        for g in {tuple(w[k : k + 4]) for k in range(len(w) - 3)}:
            pairs.update((j, i) for j in index[g] if min(len(split[j]), len(w)) >= 0.8 * max(len(split[j]), len(w)))
            index[g].append(i)
    common = {p for p in pairs if len(set(split[p[0]]) & set(split[p[1]])) >= 0.5 * len(set(split[p[0]]))}
    codes = {}
    coded = [[codes.setdefault(x, len(codes)) for x in w] for w in split]
    return [p for p in common if banded_distance(coded[p[0]], coded[p[1]], m := int(0.2 * max(len(coded[p[0]]), len(coded[p[1]])) + 1e-9)) <= m]


def test_near_copies_on_documents(spark):
    """Of the near pairs of sf0.01, by brute force, nearly all are one class, and the pipeline leaves one of each."""
    import corpus_pipeline

    from larkspan.llm import near_dedup

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    pairs = [(rows[i]["doc_id"], rows[j]["doc_id"]) for i, j in near_pairs([r["text"] for r in rows])]
    assert len(pairs) > 50
    found = {r["ord"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    hits = sum(found[i] == found[j] for i, j in pairs)
    print(f"near pairs in one class: {hits} of {len(pairs)}")
    assert hits >= 0.97 * len(pairs)
    work = corpus_pipeline.Scratch(spark, "test-near")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    both = sum(i in left and j in left for i, j in pairs)
    print(f"near pairs with both left after the stage: {both} of {len(pairs)}")
    assert both <= 0.05 * len(pairs)
