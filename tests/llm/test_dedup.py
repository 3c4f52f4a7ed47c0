"""op1, op8 and op10 against brute force."""

import re
from itertools import pairwise

import pytest

from larkspan.llm import line_dedup, linkage, near_dedup, substring_dedup

SPACE = r"[\x20\x09-\x0D]+"


def split(text):
    return [w for w in re.split(SPACE, text or "") if w]


def brute_substrings(rows, size):
    first = {}
    for i, text in rows:
        w = split(text)
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            key = i if i is not None else float("inf")
            first[g] = min(first.get(g, key), key)
    out = []
    for i, text in rows:
        w, gone = split(text), set()
        key = i if i is not None else float("inf")
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < key:
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("ids", ["plain", "ties and nulls"])
def test_substring_dedup(frame, corpus, ids):
    keys = list(range(len(corpus))) if ids == "plain" else [None if k % 9 == 0 else k // 2 for k in range(len(corpus))]
    got = [tuple(r) for r in substring_dedup.dedup(frame(corpus, keys)).collect()]
    want = brute_substrings(list(zip(keys, corpus, strict=True)), 50)
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(r[2] for r in got) > 100


def test_maximal_repeats_are_the_removed_words(frame, corpus):
    docs = frame(corpus)
    spans = substring_dedup.maximal_repeats(docs).collect()
    removed = {}
    for r in spans:
        assert r["end"] - r["start"] >= 50
        removed[r["doc_id"]] = removed.get(r["doc_id"], 0) + r["end"] - r["start"]
    want = {i: n for i, _, n, _ in brute_substrings(list(enumerate(corpus)), 50) if n}
    assert removed == want


def test_empty_tables(frame):
    none = frame([])
    assert substring_dedup.dedup(none).count() == 0
    assert near_dedup.classes(none).count() == 0
    assert line_dedup.dedup(none).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    import random

    r = random.Random(1)
    for _ in range(1500):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 25))]
        b = [x for x in a if r.random() > 0.2] + [r.randint(0, 3) for _ in range(r.randint(0, 4))]
        most, true = r.randint(0, 10), distance(a, b)
        assert near_dedup.banded_distance(a, b, most) == (true if true <= most else most + 1)


def test_near_dedup_joins_copies_and_near_copies(frame, corpus):
    docs = frame(corpus)
    found = {r["ord"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    words = [split(t) for t in corpus]
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    for i in range(len(corpus)):
        for j in range(i):
            alike = len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])
            # A text and the same text twice over have equal k-mers but are far apart by edits.
            if len(words[i]) >= 5 and alike and distance(words[i], words[j]) <= 0.2 * max(len(words[i]), len(words[j])):
                assert found[i] == found[j]
            if (corpus[i] or "") == (corpus[j] or ""):
                assert found[i] == found[j]
    classes = {}
    for i, c in found.items():
        classes.setdefault(c, []).append(i)
    for members in classes.values():
        assert min(members) in members
        for i in members:
            if len(members) > 1 and len(words[i]) < 400:
                near = (distance(words[i], words[j]) <= 0.2 * max(len(words[i]), len(words[j])) for j in members if j != i)
                assert any(near)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)


def test_near_dedup_keeps_one_of_rows_with_one_id(frame):
    text = " ".join(f"t{k}" for k in range(40))
    docs = frame([text, text, text.replace("t20", "x"), None, None], [4, 4, 4, None, None])
    assert near_dedup.keep_one(docs).count() == 2


@pytest.mark.parametrize(("sizes", "least"), [([5, 6, 8, 10, 15, 20, 25, 32, 40], 1.0), ([60, 100, 200, 400], 0.85)])
def test_near_dedup_recall_by_edit_similarity(frame, sizes, least):
    import random

    r = random.Random(9)
    texts = []
    for n in sizes * (120 // len(sizes)):
        one = [f"v{r.randrange(30_000)}" for _ in range(n)]
        two = list(one)
        for at in r.sample(range(n), n // 5):
            two[at] = f"u{r.randrange(30_000)}"
        texts += [" ".join(one), " ".join(two)]
    found = {x["ord"]: x["class_id"] for x in near_dedup.classes(frame(texts)).collect()}
    hits = [found[i] == found[i + 1] for i in range(0, len(texts), 2)]
    print(f"recall at {sizes} words: {sum(hits)} of {len(hits)}")
    assert sum(hits) >= least * len(hits)


def normal(line):
    return tuple(split(line.lower()))


def test_line_dedup(frame):
    long = " ".join(f"word{k}" for k in range(300))
    near = long.replace("word150 ", "other ")
    texts = ["Alpha  beta\n\ngamma delta", None, "", "ALPHA beta\nnew line\r\n", f"{long}\nalpha beta", f"{near}\nown words here", "gamma delta"]
    out = {r["doc_id"]: r for r in line_dedup.dedup(frame(texts)).collect()}
    assert out[0]["text"] == texts[0]
    assert out[1]["text"] is None
    assert out[2]["text"] == ""
    assert out[3]["text"] == "new line\r\n"
    assert out[4]["text"] == long
    assert out[5]["text"] == "own words here"
    assert out[6]["text"] == ""


def test_line_dedup_against_brute_force(frame, corpus):
    docs = frame(corpus)
    spots = {(r["ord"], r["at"]) for r in line_dedup.kept_lines(docs).collect()}
    lines = [(i, k, normal(x)) for i, t in enumerate(corpus) for k, x in enumerate((t or "").split("\n")) if normal(x)]
    first = {}
    for i, k, words in lines:
        first.setdefault(words, (i, k))
    assert spots <= set(first.values())
    kept = [w for w, at in first.items() if at in spots]
    for words, at in first.items():  # every line that went has a like line in an earlier or kept place
        if at not in spots:
            assert any(distance(words, w) <= 0.2 * max(len(words), len(w)) for w in first if w != words)
    assert len(kept) >= 10


def alike_lines(lines):
    """All pairs at a word edit similarity of 0.8, found by the words they must share."""
    from collections import Counter, defaultdict

    often = Counter(w for x in lines for w in set(x))
    index, pairs = defaultdict(list), []
    for i in sorted(range(len(lines)), key=lambda i: len(lines[i])):
        x, seen, near = lines[i], Counter(), set()
        marked = []
        for w in x:
            seen[w] += 1
            marked.append((often[w], w, seen[w]))
        marked.sort()
        most = int(0.2 * len(x) + 1e-9)
        for w in marked[: most + 1]:
            near.update(index[w])
        codes = {w: k for k, w in enumerate(dict.fromkeys(x))}
        for j in near:
            y = lines[j]
            if len(y) >= len(x) - most:
                other = [codes.setdefault(w, len(codes)) for w in y]
                if near_dedup.banded_distance([codes[w] for w in x], other, most) <= most:
                    pairs.append((min(i, j), max(i, j)))
        for w in marked[: int(0.25 * len(x) + 1e-9) + 1]:
            index[w].append(i)
    return pairs


def groups_of(n, pairs):
    root = list(range(n))

    def end(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        u, v = end(i), end(j)
        root[max(u, v)] = min(u, v)
    return [end(i) for i in range(n)]


@pytest.mark.parametrize("crowd", [linkage.CROWD, 2])
def test_line_dedup_recall(frame, monkeypatch, crowd):
    import random

    monkeypatch.setattr(linkage, "CROWD", crowd)
    r = random.Random(5)
    vocab = [f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(5000)]
    lines = []
    for n in [4, 5, 6, 8, 10, 11, 15, 20, 25, 40, 48, 55, 61, 70, 100, 120] * 4:
        one = [r.choice(vocab) for _ in range(n)]
        two = list(one)
        for _ in range(max(1, n // 10)):
            at = r.randrange(len(two))
            two[at : at + r.randint(0, 1)] = [r.choice(vocab)] * r.randint(0, 1)
        lines += [tuple(one), tuple(two)]
    lines = [x for x in dict.fromkeys(lines) if x]
    pairs = alike_lines(lines)
    assert sorted(pairs) == sorted((j, i) for i in range(len(lines)) for j in range(i) if distance(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9)
    root = groups_of(len(lines), pairs)
    gone = {i for i in range(len(lines)) if root[i] != i}
    kept = {x["ord"] for x in line_dedup.kept_lines(frame([" ".join(x) for x in lines])).collect()}
    assert len(gone) >= 40
    assert set(range(len(lines))) - kept <= gone
    assert len(gone - kept) >= 0.95 * len(gone)


def test_line_dedup_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    first = {}
    for d, t in sorted((r["doc_id"], r["text"]) for r in docs.collect()):
        for k, x in enumerate(t.split("\n")):
            if normal(x):
                first.setdefault(normal(x), (d, k))
    lines = list(first)
    root = groups_of(len(lines), alike_lines(lines))
    gone = {i for i in range(len(lines)) if root[i] != i}
    kept = {(r["ord"], r["at"]) for r in line_dedup.kept_lines(docs).collect()}
    left = {i for i, x in enumerate(lines) if first[x] in kept}
    print(f"recall of lines: {len(gone - left)} of {len(gone)}")
    assert set(range(len(lines))) - left <= gone
    assert len(gone - left) >= 0.95 * len(gone)


def test_components_of_a_long_chain(spark):
    from larkspan.llm.linkage import components
    from larkspan.llm.scratch import Scratch

    order = [5, 17, 2, 9, 30, 1, 22, 14, 8, 40]
    edges = spark.createDataFrame([(min(p), max(p)) for p in pairwise(order)] + [(50, 60), (50, 60)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(Scratch(spark, "test"), edges, "chain").collect()}
    assert got == {x: 1 for x in order if x != 1} | {60: 50}


def test_form_documents_that_share_most_of_their_words(frame):
    """Pairs whose every common run of words is a form that all others share too."""
    import random

    r = random.Random(21)
    form = [f"form{k}" for k in range(40)]
    texts = []
    for p in range(150):
        one = [f"own{r.randrange(10_000)}" for _ in range(20)]
        two = list(one)
        for at in r.sample(range(20), 10):
            two[at] = f"new{r.randrange(10_000)}"
        for own in (one, two):
            texts.append(" ".join(form[:20] + own + form[20:]) if p % 2 else " ".join(form + own))
    found = {x["ord"]: x["class_id"] for x in near_dedup.classes(frame(texts)).collect()}
    hits = sum(found[i] == found[i + 1] for i in range(0, 300, 2))
    print(f"form documents: {hits} of 150")
    assert hits >= 0.95 * 150
    assert len(set(found.values())) >= 150 - 3


@pytest.mark.parametrize("values", [75, 19])
def test_lines_of_one_template(frame, values):
    """Eight fixed words and four fields: every bucket is crowded with lines of the template."""
    import random

    r = random.Random(values)
    lines = []
    for _ in range(1500):
        f = [f"f{k}v{r.randrange(values)}" for k in range(4)]
        lines.append(("a", f[0], "b", "c", f[1], "d", "e", f[2], "g", "h", f[3], "i"))
    lines = list(dict.fromkeys(lines))
    root = groups_of(len(lines), alike_lines(lines))
    gone = {i for i in range(len(lines)) if root[i] != i}
    kept = {x["ord"] for x in line_dedup.kept_lines(frame([" ".join(x) for x in lines])).collect()}
    left = set(range(len(lines))) & kept
    print(f"lines of a template, {values} values: {len(gone - left)} of {len(gone)}")
    assert set(range(len(lines))) - left <= gone
    assert len(gone - left) >= 0.99 * len(gone) > 0


def test_first_words_are_enough_for_every_alike_pair():
    import random

    import numpy as np

    from larkspan.llm import rare_words

    r = random.Random(8)
    tried = 0
    for _ in range(4000):
        n = r.randint(5, 60)
        a = [r.randrange(40) for _ in range(n)]
        b = list(a)
        for _ in range(r.randint(0, n // 5 + 2)):
            at = r.randrange(len(b))
            b[at : at + r.randint(0, 1)] = [r.randrange(40)] * r.randint(0, 1)
        if not b or distance(a, b) > int(0.2 * max(n, len(b)) + 1e-9) or len(set(a) & set(b)) < 2 or len(b) > 60:
            continue
        order = list(range(40))
        r.shuffle(order)
        keys = []
        for x in (a, b):
            u, v = rare_words.pairs(np.array(sorted(set(x), key=order.index)), len(x), 0.8)
            keys.append(set(zip(u.tolist(), v.tolist(), strict=True)))
        assert keys[0] & keys[1]
        tried += 1
    assert tried > 1000


def test_alike_lines_are_cut_and_numbered_once(frame):
    """Pairs of lines are compared by their words; the words of a pair are not made again for each of them."""
    import random
    import time

    r = random.Random(31)
    lines = []
    for _ in range(8):
        one = [f"word{r.randrange(900)}" for _ in range(6000)]
        two = list(one)
        for at in r.sample(range(6000), 100):
            two[at] = f"other{r.randrange(900)}"
        lines += [" ".join(one), " ".join(two)]
    began = time.monotonic()
    kept = {x["ord"] for x in line_dedup.kept_lines(frame(lines)).collect()}
    took = time.monotonic() - began
    print(f"8 pairs of lines of 6,000 words: {took:.0f} s")
    assert kept == set(range(0, 16, 2))
    assert took < 60
