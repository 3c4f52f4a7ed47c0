"""Language ID by interpolated Kneser-Ney character models.

One model per language over letters in lower case and word breaks.  Counts come
from a bounded sample of labelled texts: spans of at most SPAN characters, picked by a
hash of doc_id and place, about ``max_chars`` characters a language and ``max_total`` in
all, so long texts teach in part and many languages share the bound.  All models share
sorted arrays of n-gram hashes with one column of log probabilities per language, so a
position of a text costs one lookup for its longest n-gram and another only where that
was never seen.  The language with the least cross-entropy per character wins; a text is
accepted if that cross-entropy stays under the language's threshold, a high quantile over
training spans that were kept out of the counts.  The same spans calibrate the score.

Defined cases: a null text or one without letters is ``und`` with score 0; rows
whose language is null, and texts without letters, teach nothing; without any training row
every text is ``und``; a language of one span has no threshold; repeated rows are each
predicted (and may each be learnt); lang, source and doc_id are not used to predict; a
text is held whole in one task, which takes about 100 times its bytes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A

ORDER = 4
#: Characters that each language's counts are taken from, about, and all languages' together.
MAX_CHARS, MAX_TOTAL = 3_000_000, 24_000_000
#: Characters of a text that are picked together, at most.
SPAN = 20_000
#: Share of a language's sampled documents kept for its threshold.
HELD_SHARE = 10
QUANTILE = 0.995
#: A score counts at most so many characters as independent evidence; the one that suits the kept spans best.
EVIDENCE = (5, 10, 20, 40, 80, 160)
UND = "und"
_UNSEEN = 1e-7


@lru_cache(1)
def _fold_table() -> np.ndarray:
    """Code point to lower-case code point for letters, 32 for all else."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case with single breaks (32) between words, and text starts.

    Every text begins with a break; one without letters is a single break.
    """
    joined = "\n".join(["", *texts, ""])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.r_[0, np.cumsum(size)]
    codes = _fold_table()[raw]
    doc_break = np.zeros(len(codes), bool)
    doc_break[begin] = True
    keep = (codes != 32) | np.r_[True, codes[:-1] != 32] | doc_break
    # A break before a text's own leading break, or after its trailing one, is the text's boundary.
    total = np.r_[0, np.cumsum(keep)]
    return codes[keep].astype(np.uint64), total[begin]


def places(n_codes: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each code and how many codes of it stand before; -1 after the last text."""
    position = np.arange(n_codes)
    doc = np.searchsorted(begin, position, "right") - 1
    return doc, np.where(doc < len(begin) - 1, position - begin[np.minimum(doc, len(begin) - 1)], -1)


#: Odd numbers without a common relation, one for each place in an n-gram.
_FACTORS = A.mix(np.arange(16, dtype=np.uint64), 60) | np.uint64(1)


def gram_keys(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """keys[n][i]: hash of the n codes that end at i, for i >= n - 1 (0 before)."""
    keys = [np.zeros(len(codes), np.uint64)]
    for n in range(1, order + 1):
        key = np.zeros(len(codes), np.uint64)
        for back in range(n):
            part = codes[: len(codes) - back] if back else codes
            key[back:] += part * _FACTORS[back]
        key = A.mix(key, n)
        key[: n - 1] = 0
        keys.append(key)
    return keys


class Table:
    """Sorted hashes with rows of values; a directory on the top bits narrows the search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.most = int(np.diff(self.first).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where there is none."""
        bucket = (keys >> self.shift).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(keys), -1, np.int64)
        for _ in range(self.most):
            live = np.flatnonzero((at < stop) & (out < 0))
            if not len(live):
                break
            hit = live[self.keys[at[live]] == keys[live]]
            out[hit] = at[hit]
            at[live] += 1
        return out


class Model:
    """Tables for n-grams and for the back-off weight of contexts, per order."""

    def __init__(self, langs: list[str], order: int):
        self.langs, self.order = langs, order
        self.grams: list[Table] = []
        self.backoff: list[Table] = []
        self.floor = np.zeros(len(langs))
        self.limit = np.full(len(langs), np.inf)
        self.evidence = EVIDENCE[len(EVIDENCE) // 2]

    def log_probs(self, keys: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
        """log P of the code at each position by every language, from order n down."""
        if n == 0:
            return np.broadcast_to(self.floor, (len(at), len(self.langs)))
        table = self.grams[n - 1]
        row = table.find(keys[n][at])
        out = table.values[row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            lower = self.log_probs(keys, at[miss], n - 1).copy()
            if n > 1:
                context = self.backoff[n - 2].find(keys[n - 1][at[miss] - 1])
                known = context >= 0
                lower[known] += self.backoff[n - 2].values[context[known]]
            out[miss] = lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character by text and language, and the characters scored."""
        codes, begin = folded(texts)
        keys = gram_keys(codes, self.order)
        n = len(texts)
        position = np.arange(len(codes))
        doc, back = places(len(codes), begin)
        scored = back > 0
        where, doc, back = position[scored], doc[scored], back[scored]
        total = np.zeros((n, len(self.langs)))
        for n_gram in range(1, self.order + 1):
            # After k codes of the text, the longest usable n-gram has k + 1 codes, at most ``order``.
            mine = (np.minimum(back + 1, self.order) == n_gram) if n_gram < self.order else (back + 1 >= self.order)
            at = where[mine]
            if len(at):
                p = self.log_probs(keys, at, n_gram)
                for j in range(len(self.langs)):
                    total[:, j] -= np.bincount(doc[mine], p[:, j], n)
        count = np.bincount(doc, minlength=n)
        letters = np.bincount(doc[codes[where] != 32], minlength=n)
        return total / np.maximum(count, 1)[:, None], letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and acceptance of each text."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        h, letters = self.entropies(texts)
        best = h.argmin(1)
        gap = np.minimum(letters, self.evidence)[:, None] * (h - h.min(1, keepdims=True))
        score = 1 / np.exp(-gap).sum(1)
        some = letters > 0
        names = [self.langs[b] if s else UND for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        return names, np.where(some, score, 0.0), some & (h[np.arange(len(texts)), best] <= self.limit[best])


def _kneser_ney(keys: list[np.ndarray], back: np.ndarray, order: int) -> tuple[list[dict], list[dict]]:
    """Per order: (keys, log P) of seen n-grams and (keys, log weight) of contexts.

    ``back`` says how many codes of its text stand before each; no n-gram begins in another text.
    """
    grams, weights = [], []
    distinct = []
    for n in range(1, order + 1):
        positions = np.flatnonzero(back >= max(n - 1, 1))
        key, first, count = np.unique(keys[n][positions], return_index=True, return_counts=True)
        distinct.append((key, positions[first], count))
    lower = None
    for n in range(1, order + 1):
        key, at, count = distinct[n - 1]
        if n < order:  # continuation counts: distinct codes before the n-gram
            longer = distinct[n]
            tail, found = np.unique(keys[n][longer[1]], return_counts=True)
            where = np.minimum(np.searchsorted(tail, key), len(tail) - 1)
            count = np.where(tail[where] == key, found[where], 1)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))
        context = keys[n - 1][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
        ctx, group = np.unique(context, return_inverse=True)
        total = np.bincount(group, count)
        weight = discount * np.bincount(group) / total
        if lower is None:
            base = np.full(len(key), 1.0 / (len(key) + 1))
        else:
            base = np.exp(lower[1][np.searchsorted(lower[0], keys[n - 1][at])])
        p = (count - discount) / total[group] + weight[group] * base
        lower = (key, np.log(p))
        grams.append({"keys": key, "values": np.log(p)})
        weights.append({"keys": ctx, "values": np.log(weight)})
    return grams, weights


def fit(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Models of all languages from texts by language; one in HELD_SHARE texts sets thresholds."""
    texts = {x: some for x in sorted(texts) if (some := [t for t in texts[x] if any(map(str.isalpha, t))])}
    langs = list(texts)
    model = Model(langs, order)
    if not langs:
        return model
    step = {x: max(2, min(HELD_SHARE, len(t))) for x, t in texts.items()}
    held = {x: t[:: step[x]] if len(t) > 1 else [] for x, t in texts.items()}
    learnt = {x: [v for i, v in enumerate(t) if i % step[x]] if len(t) > 1 else t for x, t in texts.items()}
    parts, each = {}, {n: {} for n in range(1, order + 1)}
    for x in langs:  # what is kept of a language is a row for each different n-gram
        codes, begin = folded(learnt.pop(x))
        keys, back = gram_keys(codes, order), places(len(codes), begin)[1]
        parts[x] = _kneser_ney(keys, back, order)
        for n in each:
            at = np.flatnonzero(back >= max(n - 1, 1))
            k, first = np.unique(keys[n][at], return_index=True)
            each[n][x] = (k, keys[n - 1][at[first]], keys[n - 1][at[first] - 1])
        del codes, keys, back, at, k, first
    model.floor = np.array([np.log(np.exp(parts[x][1][0]["values"][0]) * _UNSEEN) for x in langs])
    for n in range(1, order + 1):
        seen = each.pop(n)
        union = np.unique(np.concatenate([v[0] for v in seen.values()]))
        suffix, context = np.zeros(len(union), np.uint64), np.zeros(len(union), np.uint64)
        for v in seen.values():
            at = np.searchsorted(union, v[0])
            suffix[at], context[at] = v[1], v[2]
        values = np.zeros((len(union), len(langs)), np.float32)
        for j, x in enumerate(langs):
            # What this language has not seen backs off, once and for all, when the table is made.
            values[:, j] = model.floor[j] if n == 1 else model.grams[n - 2].values[model.grams[n - 2].find(suffix), j]
            if n > 1:
                w = parts[x][1][n - 1]
                at = np.minimum(np.searchsorted(w["keys"], context), len(w["keys"]) - 1)
                values[:, j] += np.where(w["keys"][at] == context, w["values"][at], 0.0)
            g = parts[x][0][n - 1]
            values[np.searchsorted(union, g["keys"]), j] = g["values"]
        model.grams.append(Table(union, values))
        if n > 1:
            every = np.unique(np.concatenate([parts[x][1][n - 1]["keys"] for x in langs]))
            weight = np.zeros((len(every), len(langs)))
            for j, x in enumerate(langs):
                w = parts[x][1][n - 1]
                weight[np.searchsorted(every, w["keys"]), j] = w["values"]
            model.backoff.append(Table(every, weight))
    found = {j: model.entropies(held[x]) for j, x in enumerate(langs) if held[x]}
    for j, (h, _) in found.items():
        model.limit[j] = np.quantile(h[:, j], QUANTILE)
    if found:
        model.evidence = min(EVIDENCE, key=lambda e: sum(_loss(h, j, np.minimum(n, e)) for j, (h, n) in found.items()))
    return model


def _loss(h: np.ndarray, own: int, n: np.ndarray) -> float:
    """Minus the log probability of the right language, over texts with ``n`` characters of evidence."""
    margin = -n[:, None] * (h - h[:, [own]])
    most = margin.max(1)
    return float((most + np.log(np.exp(margin - most[:, None]).sum(1))).sum())


def train(docs: DataFrame, rows: Column, order: int = ORDER, max_chars: int = MAX_CHARS, max_total: int = MAX_TOTAL) -> Model:
    """Fit on a sample of the labelled ``rows``: about ``max_chars`` characters a language, ``max_total`` in all."""
    usable = docs.where(rows & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").agg(F.sum(F.char_length("text")).alias("size")).collect()  # one row per language
    sizes = {r["lang"]: r["size"] for r in sizes if r["size"]}
    if not sizes:
        return fit({}, order)
    most = min(max_chars, max(1, max_total // len(sizes)))
    cut = F.element_at(F.create_map(*[F.lit(v) for k, size in sizes.items() for v in (k, int(1_000_000 * min(1.0, most / size)))]), F.col("lang"))
    span = max(200, min(SPAN, most // 50))  # many spans a language, so that some are picked of each
    spans = F.sequence(F.lit(0), F.floor((F.greatest(F.char_length("text"), F.lit(1)) - 1) / span).cast("int"))
    picked = F.filter(spans, lambda i: F.pmod(F.xxhash64("doc_id", i, F.lit("lang")), F.lit(1_000_000)) < cut)
    got = usable.select("doc_id", "lang", "text", F.explode(picked).alias("at")).select("doc_id", "lang", "at", F.substr("text", F.col("at") * span + 1, F.lit(span)).alias("text"))
    got = got.toArrow().sort_by([(c, "ascending") for c in ("lang", "doc_id", "at", "text")])
    texts: dict[str, list[str]] = {}
    for lang, text in zip(got["lang"].to_pylist(), got["text"].to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    return fit(texts, order)


def identify(docs: DataFrame, rows: Column, order: int = ORDER, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows, order, max_chars))  # n-grams of MAX_TOTAL characters at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches, limit=A.CHUNK_BYTES // 2):
            texts = pc.fill_null(chunk.column("text"), "").to_pylist()
            names, score, accepted = model.value.predict(texts)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
