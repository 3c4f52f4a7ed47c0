"""Substring dedup by seed and extend.

Seeds: of the 16-word grams of each 50-word window the one with the least hash
is its anchor (winnowing), so equal windows have equal anchors at equal places.
A maximal run of windows with one anchor is a segment; it is the anchor extended
both ways as far as the anchor can witness a window.  Segments are joined on
anchors that more than one document has.

Extension: occurrences of one segment (equal in every word) form a class, and
all but those of the class's first document are repeats as a whole.  Only one
representative of a class, and only where an anchor has different segments, is
compared window by window: a window's exact words are looked up by a 128-bit
hash, and the first document that holds it is found by a minimum.  Nothing is
compared pairwise, so a passage that a third of all documents share costs one
row per occurrence.  Adjacent repeated windows merge to maximal repeats.

Defined cases: a null text has no words; texts under 50 words lose nothing; a
null doc_id counts as the largest; rows with one doc_id do not remove each other;
only doc_id and the text are read, so other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .keys import keyed
from .scratch import Scratch

WINDOW = 50
#: Words of an anchor. A window has WINDOW - ANCHOR + 1 of them to choose from, at most 63.
ANCHOR = 16

_SEGMENT = "ord long, fp long, anchor long, segment long, lo int, n int"


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each ``width`` consecutive values, the last of ties.

    Doubling: the least of a long run is the lesser of two shorter runs' least.
    """
    best, size = np.arange(len(x)), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[:-step] if step else best, best[step:]
        best = np.where(x[right] <= x[left], right, left)
        size += step
    return best


def _word_hashes(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray]:
    start, end, doc = A.words(chunk)
    return A.span_hashes(chunk.bytes, start, end), doc


def _segments(size: int, anchor: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches):
            hashes, doc = _word_hashes(chunk)
            m = len(hashes)
            if m < size:
                continue
            sums = A.gram_sums(hashes)
            at = np.arange(m - anchor + 1)
            grams = A.gram_hashes(sums, at, at + anchor, 1)
            least = _sliding_argmin(grams, size - anchor + 1)
            windows = np.arange(m - size + 1)
            whole = doc[windows] == doc[windows + size - 1]
            windows, least = windows[whole], least[whole]
            if not len(windows):
                continue
            new = np.r_[True, (np.diff(least) != 0) | (np.diff(windows) != 1)]
            lo = windows[new]
            n = np.diff(np.r_[np.flatnonzero(new), len(windows)])
            where = least[new]
            # The segment's words and the anchor's place in it.
            segment = A.mix(A.gram_hashes(sums, lo, lo + n + size - 1, 2) ^ (where - lo).astype(np.uint64), 3)
            row = doc[lo]
            first = np.searchsorted(doc, np.arange(len(chunk)))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("ord").take(pa.array(row)), chunk.column("fp").take(pa.array(row)), pa.array(A.signed(grams[where])), pa.array(A.signed(segment)), pa.array((lo - first[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["ord", "fp", "anchor", "segment", "lo", "n"],
            )

    return run


def segments(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Every segment of every document: its anchor, content hash, first window and number of windows."""
    return keyed(docs).select("ord", "fp", "text").mapInArrow(_segments(size, anchor), _SEGMENT)


def _windows(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches):
            hashes, doc = _word_hashes(chunk)
            first = np.searchsorted(doc, np.arange(len(chunk)))
            asked = chunk.column("asked")
            count = np.asarray(pc.list_value_length(asked))
            flat = asked.flatten()
            row = np.repeat(np.arange(len(chunk)), count)
            lo, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (2, 3))
            item = np.repeat(np.arange(len(lo)), n)
            bit = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            at = (first[row] + lo)[item] + bit
            keys = [A.signed(A.gram_hashes(A.gram_sums(hashes, w), at, at + size, 4 + w)) for w in (0, 1)]
            picked = pa.array(item)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("ord").take(pa.array(row[item])), flat.field(0).take(picked), flat.field(1).take(picked), pa.array(bit.astype(np.int32)), pa.array(keys[0]), pa.array(keys[1])],
                ["ord", "anchor", "segment", "bit", "w1", "w2"],
            )

    return run


def repeated_segments(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Segments with repeated windows: ord, fp, lo, n and mask.

    Bit i of ``mask`` is set if window lo + i also starts in an earlier document.
    """
    work = Scratch(docs.sparkSession, "substring")
    found = segments(docs, size, anchor)
    shared = found.groupBy("anchor").agg(F.min("ord").alias("a"), F.max("ord").alias("b"), (F.min("segment") < F.max("segment")).alias("mixed"))
    shared = work.save(shared.where("a < b").select("anchor", "mixed"), "anchors")
    seeds = work.save(found.join(shared, "anchor"), "seeds")

    classes = seeds.groupBy("anchor", "segment").agg(F.min(F.struct("ord", "fp", "lo")).alias("at"), F.max("ord").alias("last"), F.first("n").alias("n"), F.first("mixed").alias("mixed"))
    classes = work.save(classes, "classes")
    asked = classes.where("mixed").select(F.col("at.ord").alias("ord"), F.col("at.fp").alias("fp"), F.struct("anchor", "segment", F.col("at.lo").alias("lo"), "n").alias("one"))
    asked = asked.groupBy("ord", "fp").agg(F.collect_list("one").alias("asked"))  # bounded by one document's segments
    texts = keyed(docs).select("ord", "fp", "text")
    windows = texts.join(asked, ["ord", "fp"]).select("ord", "text", "asked").mapInArrow(_windows(size), "ord long, anchor long, segment long, bit int, w1 long, w2 long")
    windows = work.save(windows, "windows")
    first = work.save(windows.groupBy("w1", "w2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last").drop("last"), "first")
    masks = windows.join(first, ["w1", "w2"]).where("ord > first").groupBy("anchor", "segment").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))

    known = classes.select("anchor", "segment", F.col("at.ord").alias("first"), "last").join(masks, ["anchor", "segment"], "left")
    known = work.save(known.where("first < last OR mask IS NOT NULL"), "known")
    out = seeds.drop("mixed").join(known, ["anchor", "segment"])
    whole = F.expr("shiftleft(1L, n) - 1")
    return out.select("ord", "fp", "lo", "n", F.when(F.col("ord") > F.col("first"), whole).otherwise(F.col("mask")).alias("mask")).where("mask IS NOT NULL")


def _covered(lo: np.ndarray, mask: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Which words of a document lie in a repeated window."""
    edge = np.zeros(n_words + 1, np.int32)
    bits = (mask[:, None] >> np.arange(63)) & 1
    which, bit = np.nonzero(bits)
    start = lo[which] + bit
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return np.cumsum(edge[:-1]) > 0


def with_repeats(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, text and ``repeats``, an array of (lo, mask), null where there are none."""
    spans = repeated_segments(docs, size, anchor).groupBy("ord", "fp").agg(F.collect_set(F.struct("lo", "mask")).alias("repeats"))
    return keyed(docs).join(spans, ["ord", "fp"], "left").select("doc_id", "text", "repeats")


def kept_words(text: bytes, repeats: list | None, size: int) -> tuple[list[bytes], np.ndarray | None]:
    """All words of a text, and which of them are repeats (None: none)."""
    words = text.split()
    if not repeats:
        return words, None
    lo, mask = (np.array([r[k] for r in repeats], np.int64) for k in ("lo", "mask"))
    return words, _covered(lo, mask, size, len(words))


def maximal_repeats(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per maximal removed span: doc_id, start and end in words (end exclusive)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc_id, text, repeats in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _, gone = kept_words((text or "").encode(), repeats, size)
                if gone is not None:
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    starts += edge[::2].tolist()
                    ends += edge[1::2].tolist()
                    ids += [doc_id] * (len(edge) // 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start", "end"])

    return with_repeats(docs, size, anchor).where("repeats IS NOT NULL").mapInArrow(run, "doc_id long, start long, end long")


def dedup(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text: words joined by one space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches):
            total, removed, kept = [], [], []
            for i, repeats in enumerate(chunk.column("repeats").to_pylist()):
                words, gone = kept_words(chunk.text(i), repeats, size)
                total.append(len(words))
                removed.append(0 if gone is None else int(gone.sum()))
                kept.append(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return with_repeats(docs, size, anchor).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
