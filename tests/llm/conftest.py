import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __lines int, ord string, fp string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with columns whose names an operator might use itself."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", "y") for i, t in zip(ids, texts, strict=True)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random words with copies, near copies, shared passages, odd spacing, empties and nulls."""
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["é", "Ü", "tab ", "the"]
    passage = [r.choice(vocab) for _ in range(70)]
    texts = [None, "", " \n\t ", "one", "a b c d"]
    for k in range(40):
        words = [r.choice(vocab) for _ in range(r.randint(1, 160))]
        if k % 5 == 0:
            at = r.randint(0, len(words))
            words[at:at] = passage[r.randint(0, 15) :]
        texts.append(r.choice([" ", "  ", "\n"]).join(words))
    texts += texts[10:16]
    for t in texts[16:22]:
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts.append(" ".join(r.choice(vocab) for _ in range(6000)))
    texts.append(" ".join(passage * 2))
    return texts
