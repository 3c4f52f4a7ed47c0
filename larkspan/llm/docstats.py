"""Statistics of whole documents, computed for many at once from their bytes."""

from __future__ import annotations

import numpy as np

from . import arrays as A

SYMBOLS = A.byte_class(b"#*$%&|<>")
_UPPER = A.byte_class(range(0x41, 0x5B))
_LOWER = A.byte_class(range(0x61, 0x7B))
_DIGIT = A.byte_class(range(0x30, 0x3A))
_STOP = A.byte_class(b".!?")
_PUNCT = A.byte_class(b",;:'\"()-")
_HIGH = A.byte_class(range(0x80, 0x100))
_NEWLINE = A.byte_class(b"\n")


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: has its document another equal one, and an earlier one."""
    order = np.lexsort((np.arange(len(keys)), keys, doc)) if len(keys) < 2 else np.argsort(A.mix(keys ^ A.mix(doc.astype(np.uint64), 9)), kind="stable")
    k, d = keys[order], doc[order]
    same = np.r_[False, (k[1:] == k[:-1]) & (d[1:] == d[:-1])] if len(k) else np.zeros(0, bool)
    again, earlier = np.zeros(len(k), bool), np.zeros(len(k), bool)
    earlier[order] = same
    again[order] = same | np.r_[same[1:], False] if len(k) else same
    return again, earlier


class Stats:
    """Word and line structure of a chunk and counts by document."""

    def __init__(self, chunk: A.Chunk):
        self.chunk, self.n = chunk, len(chunk)
        self.start, self.end, self.doc = A.words(chunk)
        self.hashes = A.span_hashes(chunk.bytes, self.start, self.end)
        self.n_words = np.bincount(self.doc, minlength=self.n)

    def word_chars(self) -> np.ndarray:
        data = self.chunk.bytes
        return per_doc(~A.SPACES[data] & ((data & 0xC0) != 0x80), self.chunk.offsets)

    def n_symbols(self) -> np.ndarray:
        return per_doc(SYMBOLS[self.chunk.bytes], self.chunk.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of the newline-separated lines that have a word."""
        data, offsets = self.chunk.bytes, self.chunk.offsets
        breaks = np.flatnonzero(_NEWLINE[data])
        start = np.unique(np.r_[offsets[:-1], breaks + 1])
        start = start[start < len(data)]
        end = np.searchsorted(np.r_[breaks, len(data)], start)
        end = np.r_[breaks, len(data)][end]
        doc = np.searchsorted(offsets, start, "right") - 1
        end = np.minimum(end, offsets[doc + 1])
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~A.SPACES[data], out=total[1:])
        some = total[end] > total[start]
        return start[some], end[some], doc[some]

    def n_lines_and_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        start, end, doc = self.lines()
        _, earlier = _repeats(A.span_hashes(self.chunk.bytes, start, end), doc)
        return np.bincount(doc, minlength=self.n), np.bincount(doc[earlier], minlength=self.n)

    def n_repeat_words(self, size: int = 5) -> np.ndarray:
        """Words inside ``size``-word windows that the document has twice or more."""
        m = len(self.hashes)
        if m < size:
            return np.zeros(self.n, np.int64)
        at = np.arange(m - size + 1)
        at = at[self.doc[at] == self.doc[at + size - 1]]
        grams = A.gram_hashes(A.gram_sums(self.hashes), at, at + size, 6)
        again, _ = _repeats(grams, self.doc[at])
        edge = np.zeros(m + 1, np.int64)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + size, -1)
        return np.bincount(self.doc[np.cumsum(edge[:-1]) > 0], minlength=self.n)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of each run of ``size`` words."""
        at = np.arange(max(0, len(self.hashes) - size + 1))
        at = at[self.doc[at] == self.doc[at + size - 1]]
        return A.gram_hashes(A.gram_sums(self.hashes), at, at + size, 10 + size), self.doc[at]


FEATURES = (
    "log_words", "mean_word", "sd_word", "long_words", "short_words", "symbol_share", "symbol_words", "lone_symbols",
    "upper_share", "digit_share", "stop_share", "punct_share", "high_share", "words_per_line", "dup_lines", "repeat_words",
    "distinct_words", "capital_words", "same_as_previous", "top_length_share",
)


def features(chunk: A.Chunk) -> np.ndarray:
    """One row of FEATURES per document; an empty text has zeros."""
    s, data, offsets = Stats(chunk), chunk.bytes, chunk.offsets
    n_words = s.n_words
    words, size = np.maximum(n_words, 1), np.maximum(np.diff(offsets), 1)
    length = (s.end - s.start).astype(np.float64)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(s.doc[flags], minlength=s.n) / words

    def bytes_share(table: np.ndarray) -> np.ndarray:
        return per_doc(table[data], offsets) / size

    mean = np.bincount(s.doc, length, s.n) / words
    square = np.bincount(s.doc, length * length, s.n) / words
    n_lines, dup_lines = s.n_lines_and_repeats()
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOLS[data], out=symbols[1:])
    with_symbol = symbols[s.end] - symbols[s.start]
    _, earlier = _repeats(s.hashes, s.doc)
    first = _UPPER[data[s.start]] if len(s.start) else np.zeros(0, bool)
    previous = np.r_[False, (s.hashes[1:] == s.hashes[:-1]) & (s.doc[1:] == s.doc[:-1])] if len(s.doc) else np.zeros(0, bool)
    columns = [
        np.log1p(n_words), mean, np.sqrt(np.maximum(square - mean * mean, 0)), share(length > 12), share(length <= 3),
        bytes_share(SYMBOLS), share(with_symbol > 0), share((with_symbol == length) & (length > 0)),
        bytes_share(_UPPER), bytes_share(_DIGIT), bytes_share(_STOP), bytes_share(_PUNCT), bytes_share(_HIGH),
        n_words / np.maximum(n_lines, 1), dup_lines / np.maximum(n_lines, 1), s.n_repeat_words() / words,
        1 - np.bincount(s.doc[earlier], minlength=s.n) / words, share(first), share(previous), share(length == 4),
    ]
    return np.stack(columns, 1).astype(np.float32)
