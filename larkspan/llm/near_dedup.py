"""Near-duplicate documents by Order MinHash.

A text is its sequence of five-word k-mers, each labelled with its occurrence
number.  Every one of SKETCHES hash functions picks the ORDER k-mers with the
least hashes and keeps them in text order; the hash of that sequence is a bucket
key, so texts meet in a bucket if they share those k-mers in the same order,
which follows edit similarity rather than mere overlap.  Bucket mates are
verified by banded alignment of their words: an edit similarity of 0.8 or more
is a link.  Words replaced at random at an edit similarity of 0.8 leave a Jaccard
similarity of about 0.2 between k-mers, so ORDER is low and there are many sketches.

Few five-word k-mers survive in short texts, so texts of up to SHORT / SIMILARITY
words also have WORD_SKETCHES sketches of WORD_ORDER k-mers of one word.  Of texts
with scattered changes a few stay apart: the README gives the recall.

Texts that share crowded buckets with unlike ones, such as those of a common passage,
also meet by pairs and triples of words that are rare among them (modules linkage and rare_words).

Equal texts (by 128 bits of hashes and the length) are one class from the start and
take part as one representative.

Defined cases: null and empty texts are all one class of empty texts; texts of
fewer than five words have one k-mer, all their words; a null doc_id counts as
the largest; of a class the row with the least doc_id stays (of rows with one
doc_id and one text, one); only doc_id and text are read; a text is held whole in
one task, which takes about 60 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import rare_words as R
from .keys import LAST, order_key, second_print, sent, spare_name, without
from .linkage import SIGNATURE, components, link
from .scratch import Scratch

WORDS = 5
SKETCHES = 64
ORDER = 2
SIMILARITY = 0.8
#: A pair whose shorter text has at most so many words has sketches of single words.
SHORT = 40
WORD_SKETCHES, WORD_ORDER = 32, 3
#: Bits of a signature: fewer would all be set by the words of long texts.
BITS = 4 * SIGNATURE


def _labelled(grams: np.ndarray) -> np.ndarray:
    """K-mers with their occurrence number mixed in."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    starts = np.flatnonzero(new)
    number = np.arange(len(grams)) - starts[np.cumsum(new) - 1]
    out = np.empty_like(grams)
    out[order] = A.mix(ranked + number.astype(np.uint64), 30)
    return out


def sketch(grams: np.ndarray, sketches: int = SKETCHES, order: int = ORDER) -> np.ndarray:
    """One key for each hash function."""
    labelled = _labelled(grams)
    factors = A.mix(np.arange(sketches, dtype=np.uint64), 31) | np.uint64(1)
    keys = np.zeros(sketches, np.uint64)
    step = max(1, (1 << 20) // max(1, len(labelled)))
    for at in range(0, sketches, step):
        mine = factors[at : at + step]
        if len(labelled) > order:
            hashed = labelled[None, :] * mine[:, None]
            each, chosen = np.arange(len(mine)), np.empty((len(mine), order), np.int64)
            for j in range(order):  # a few minima are found faster than by a partition
                chosen[:, j] = hashed.argmin(axis=1)
                hashed[each, chosen[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            rows = labelled[np.sort(chosen, axis=1)]
        else:
            rows = np.broadcast_to(labelled, (len(mine), len(labelled)))
        total = mine.copy()
        for j in range(rows.shape[1]):
            total = A.mix(total ^ rows[:, j], 32)
        keys[at : at + step] = total
    return keys


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in A.chunks(batches):
        start, end, doc = A.words(chunk)
        hashes = A.span_hashes(chunk.bytes, start, end)
        sums = A.gram_sums(hashes)
        n_words = np.bincount(doc, minlength=len(chunk))
        first = np.cumsum(n_words) - n_words
        keys = []
        for f, n in zip(first.tolist(), n_words.tolist(), strict=True):
            at = np.arange(f, f + max(1, n - WORDS + 1))
            mine = sketch(A.gram_hashes(sums, at, np.minimum(at + WORDS, f + n), 33))
            if 1 < n <= SHORT / SIMILARITY:
                mine = np.r_[mine, A.mix(sketch(hashes[f : f + n], WORD_SKETCHES, WORD_ORDER), 34)]
            keys.append(mine)
        offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(A.signed(np.concatenate(keys))))
        yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in ("ord", "fp", "fp2")), pa.array(n_words.astype(np.int64)), lists], ["ord", "fp", "fp2", "size", "keys"])


def _word_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in A.chunks(batches):
        start, end, doc = A.words(chunk)
        codes = A.span_hashes(chunk.bytes, start, end).astype("<u4")
        cuts = np.cumsum(np.bincount(doc, minlength=len(chunk)))[:-1]
        yield pa.RecordBatch.from_arrays([chunk.column("fp"), pa.array([x.tobytes() for x in np.split(codes, cuts)], pa.binary())], ["fp", "words"])


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences, or ``most`` + 1 if it is larger.

    Only the band of ``most`` diagonals on either side is computed, a column at a
    time as the bits of one integer.
    """
    if len(a) < len(b):
        a, b = b, a
    lead = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        lead += 1
    a, b = a[lead:], b[lead:]
    tail = 0
    for x, y in zip(reversed(a), reversed(b), strict=False):
        if x != y:
            break
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    most = min(most, len(a))
    width = 2 * most + 2
    mask = (1 << width) - 1
    there = set(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        if x in there:
            places[x] = places.get(x, 0) | 1 << i
    up, down = mask ^ ((1 << (width - most - 1)) - 1), 0
    diagonal, across = 1 << (width - 1), 1 << (width - 2)
    distance, start, limit = most, most + 1 - width, 2 * most + len(b) - len(a)
    for i, x in enumerate(b):
        bits = places.get(x, 0)
        match = (bits << -start if start < 0 else bits >> start) & mask
        zero = ((((match & up) + up) ^ up) | match | down) & mask
        plus = (down | ~(zero | up)) & mask
        minus = zero & up
        if i < len(a) - most:
            distance += not zero & diagonal
        else:
            distance += bool(plus & across) - bool(minus & across)
            across >>= 1
        if distance > limit:
            return most + 1
        up = (minus | ~((zero >> 1) | plus)) & mask
        down = (zero >> 1) & plus
        start += 1
    return distance if distance <= most else most + 1


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """The number of words that two sequences share, whatever their order."""
    u, n = np.unique(x, return_counts=True)
    v, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def alike(a: bytes, b: bytes, similarity: float = SIMILARITY) -> bool:
    """Is the edit similarity of two sequences of word codes at least ``similarity``."""
    x, y = (np.frombuffer(v, "<u4") for v in (a, b))
    longest = max(len(x), len(y))
    most = int((1 - similarity) * longest + 1e-9)
    if longest - min(len(x), len(y)) > most or longest - _common(x, y) > most:
        return False
    return longest == 0 or banded_distance(x.tolist(), y.tolist(), most) <= most


def _align(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        good = [alike(p.as_py(), q.as_py(), similarity) for p, q in zip(x, y, strict=True)]
        kept = pa.array(np.flatnonzero(good))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"])


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many rows each slot's words are."""
    counts = np.zeros(R.SLOTS, np.int64)
    for batch in batches:
        for words in batch.column(0):
            np.add.at(counts, np.unique(np.frombuffer(words.as_buffer(), "<u4")) % R.SLOTS, 1)
    there = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], ["slot", "n"])


def _rare(batches: Iterable[pa.RecordBatch], counts: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, sigs = [], [], []
        for words in batch.column(1):
            codes = np.frombuffer(words.as_buffer(), "<u4")
            one = np.unique(codes)
            hashed = A.mix(one.astype(np.uint64), 35)
            held = counts[one % R.SLOTS]
            order = np.lexsort((hashed, held))
            ordered, held = hashed[order], held[order]
            alone = R.singles(ordered, len(codes), similarity, held)
            first, second = R.pairs(ordered, len(codes), similarity, held)
            x, y, z = R.triples(ordered, len(codes), held)
            keys.append(np.r_[A.mix(alone, 40), A.mix(first ^ A.mix(second, 36), 37), A.mix(x ^ A.mix(y ^ A.mix(z, 38), 36), 39)])
            sizes.append(len(codes))
            bits = np.zeros(BITS, np.uint8)
            bits[hashed % BITS] = 1
            sigs.append(np.packbits(bits, bitorder="little").view(np.int64))
        offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
        flat = A.signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(sizes, np.int64)), pa.array(sigs, pa.list_(pa.int64())), lists], ["id", "size", "sig", "keys"])


def _rare_keys(rows: DataFrame, codes: DataFrame, work: Scratch, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Keys of the words that are rare among ``rows``, and a signature of the words of each."""
    ids, n = work.counted(rows.select("id").distinct(), "crowd")
    words = work.save(codes.join(sent(ids, n), F.col("fp") == F.col("id")).select("id", "words"), "crowd-words")
    counts = np.zeros(R.SLOTS, np.int64)
    for r in words.select("words").mapInArrow(_word_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS rows
        counts[r["slot"]] = r["n"]
    found = words.mapInArrow(partial(_rare, counts=np.minimum(counts, 2**31 - 1).astype(np.int32), similarity=similarity), "id long, size long, sig array<long>, keys array<long>")
    found = work.save(found, "rare")
    return found.select("id", "size", F.explode("keys").alias("key")), found.select("id", "sig")


def _prints(docs: DataFrame) -> DataFrame:
    """ord, text, and two fingerprints of the text."""
    rows = docs.select(order_key().alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("ord", F.xxhash64("text").alias("fp"), second_print("text").alias("fp2"), "text")


def _classes(rows: DataFrame, work: Scratch, similarity: float) -> DataFrame:
    """fp and fp2 of each text of ``rows``, with class_id, kept_fp and kept_fp2 of its class."""
    before = list(work.names)
    drawn = rows.select("ord", "fp", "fp2", "text").mapInArrow(_sketches, "ord long, fp long, fp2 long, size long, keys array<long>")
    distinct = drawn.groupBy("fp", "fp2").agg(F.min("ord").alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    distinct = work.save(distinct, "distinct")
    prints = distinct.select("fp", "fp2", "first")

    def chosen() -> tuple[DataFrame, int]:
        """The texts that share a bucket and their number; of texts that agree in fp alone, one takes part."""
        ids = work.spark.read.parquet(f"{work.root}/asked").select(F.col("id").alias("fp"))
        one = ids.join(prints, "fp").groupBy("fp").agg(F.min(F.struct("fp2", "first")).alias("one"))
        return work.counted(one.select("fp", "one.*"), "chosen")

    def codes() -> DataFrame:
        ids, n = chosen()
        asked = sent(ids.withColumnRenamed("first", "ord"), n)
        words = rows.join(asked, ["ord", "fp", "fp2"]).select("fp", "text").mapInArrow(_word_codes, "fp long, words binary")
        return work.save(words.groupBy("fp").agg(F.first("words").alias("words")), "codes")

    known: list[DataFrame] = []

    def verify(pairs: DataFrame, n: int, name: str) -> DataFrame:
        known[:] = known or [codes()]
        pairs = sent(pairs, n)
        x, y = (known[0].select(F.col("fp").alias(i), F.col("words").alias(w)).join(pairs, i) for i, w in (("a", "x"), ("b", "y")))
        return x.join(y, ["a", "b"]).select("a", "b", "x", "y").mapInArrow(partial(_align, similarity=similarity), "a long, b long")

    def split(crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
        return _rare_keys(crowded, known[0], work, similarity)

    roots = link(work, distinct.select(F.col("fp").alias("id"), "size", "keys"), verify, split, BITS)
    members = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    linked = members.join(work.spark.read.parquet(f"{work.root}/chosen"), F.col("id") == F.col("fp")).select("fp", "fp2", "root", "first")
    linked = work.save(linked, "linked", 2 * roots.count())
    best = linked.groupBy("root").agg(F.min(F.struct("first", "fp", "fp2")).alias("kept"), F.count("*").alias("texts"))
    linked = linked.join(best, "root").select("fp", "fp2", "kept", "texts")
    own = F.struct("first", "fp", "fp2")
    by_text = prints.join(linked, ["fp", "fp2"], "left").select("fp", "fp2", F.coalesce("kept", own).alias("kept"), F.coalesce("texts", F.lit(1).cast("long")).alias("texts"))
    out = work.save(by_text.select("fp", "fp2", F.col("kept.first").alias("class_id"), F.col("kept.fp").alias("kept_fp"), F.col("kept.fp2").alias("kept_fp2"), "texts"), "classes")
    work.only("classes", *before)
    return out


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Each row's ord, fp and fp2, with class_id, kept_fp and kept_fp2 of the row of its class that stays."""
    rows = _prints(docs)
    return rows.select("ord", "fp", "fp2").join(_classes(rows, Scratch(docs.sparkSession, "near"), similarity), ["fp", "fp2"])


def _origins(docs: DataFrame, origin: DataFrame, work: Scratch) -> DataFrame | None:
    """The texts that documents' lines were taken from, with own_fp and own_fp2 of the documents; None if there are none.

    That is the text of the one row of ``origin`` with this doc_id, if it is another one, the
    document is the only one with its doc_id and each of its lines stands in that text.
    """

    def alone(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("ord") < LAST).groupBy("ord").agg(F.count("*").alias("n"), F.min("fp").alias("fp"), F.min("fp2").alias("fp2")).where("n = 1").drop("n")

    mine, theirs = _prints(docs), _prints(origin)
    before = alone(theirs).toDF("ord", "o_fp", "o_fp2")
    changed, n = work.counted(alone(mine).join(before, "ord").where("fp <> o_fp OR fp2 <> o_fp2").select("ord"), "changed")
    if not n:
        return None
    some = sent(changed, n)
    both = mine.withColumnsRenamed({"fp": "own_fp", "fp2": "own_fp2"}).join(some, "ord").join(theirs.join(some, "ord").select("ord", F.col("text").alias("whole")), "ord")
    derived = (F.size(F.array_except(F.split("text", "\n"), F.split("whole", "\n"))) == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    found = both.where(derived).select("ord", F.xxhash64("whole").alias("fp"), second_print("whole").alias("fp2"), F.col("whole").alias("text"), "own_fp", "own_fp2")
    return work.save(found, "origin")


def _one_class_a_document(found: DataFrame, work: Scratch) -> DataFrame:
    """``found`` with the classes of a document's two texts made one, kept by its least row."""
    doc, kept = ["ord", "own_fp", "own_fp2"], ["class_id", "kept_fp", "kept_fp2"]
    found = work.save(found.withColumn("node", F.xxhash64(*kept)), "texts")
    ends = found.groupBy(*doc).agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    edges, n = work.counted(ends.select("a", "b").distinct(), "same")
    if not n:
        return found
    roots = components(work, edges, "same", n)
    roots = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    nodes = found.join(sent(work.save(roots, "nodes"), 2 * n), F.col("node") == F.col("id")).select("id", "root", *kept).distinct()
    best = nodes.groupBy("root").agg(F.min(F.struct(*kept)).alias("best"))
    best = work.save(nodes.select("id", "root").join(best, "root").select("id", "best"), "best")
    marked = found.join(sent(best, 2 * n), F.col("node") == F.col("id"), "left")
    return marked.select(*doc, "fp", "fp2", *(F.coalesce(f"best.{k}", k).alias(k) for k in kept))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, origin: DataFrame | None = None) -> DataFrame:
    """The documents, with all their columns, without all but one of each class.

    Where an earlier step took lines from the documents, ``origin`` has them as they
    were, and documents are one class by their texts as they are or as they were.
    """
    work = Scratch(docs.sparkSession, "near")
    rows = _prints(docs).withColumns({"own_fp": F.col("fp"), "own_fp2": F.col("fp2")})
    before = None if origin is None else _origins(docs, origin, work)
    rows = rows if before is None else rows.unionByName(before)
    found = rows.select("ord", "fp", "fp2", "own_fp", "own_fp2").join(_classes(rows, work, similarity), ["fp", "fp2"])
    found = found if before is None else _one_class_a_document(found, work)
    stays = (F.col("ord") == F.col("class_id")) & (F.col("fp") == F.col("kept_fp")) & (F.col("fp2") == F.col("kept_fp2"))
    gone = found.groupBy("ord", "own_fp", "own_fp2").agg(F.max(stays).alias("stays")).where("NOT stays").drop("stays")
    text = F.coalesce("text", F.lit(""))
    keys = [order_key(), F.xxhash64(text), second_print(text)]
    left = without(docs, work.save(gone, "gone"), keys)
    # Rows that agree in doc_id and text are one document; only those are shuffled.
    twice = docs.select(*(k.alias(n) for k, n in zip(keys, ("ord", "fp", "fp2"), strict=True))).groupBy("ord", "fp", "fp2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    twice, n = work.counted(twice, "twice")
    if not n:
        return left
    names = [spare_name(docs, f"__same{i}") for i in range(3)]
    marked = left.withColumns(dict(zip(names, keys, strict=True)))
    again = sent(twice.toDF(*(f"{x}t" for x in names)), n)
    on = [F.col(x) == F.col(f"{x}t") for x in names]
    once = marked.join(again, on, "left_semi").dropDuplicates(names)
    return marked.join(again, on, "left_anti").unionByName(once).drop(*names)
