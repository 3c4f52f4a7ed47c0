"""Vectorised text handling inside tasks: words, word hashes, n-gram hashes.

All functions take the bytes of a chunk of documents as one numpy array, so the
cost is a few array passes per chunk whatever the number of documents.  Hashes
are a function of the content alone and are equal on every executor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; temporaries take about 60 times as much.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_ODD_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit words (the splitmix64 step)."""
    z = x + U64((_ODD_BASE * (seed + 1)) & _MASK)
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[U64(1), np.full(size - 1, self.base, U64)], dtype=U64)
            self.down = np.cumprod(np.r_[U64(1), np.full(size - 1, self.inverse, U64)], dtype=U64)
        return self.up[:n], self.down[:n]


_BYTES = _Powers(0xD6E8FEB86659FD93)
_GRAMS = (_Powers(0xA0761D6478BD642F), _Powers(0xE7037ED1A0B428DB))
_LETTERS = mix(np.arange(256, dtype=U64), 77)


class Chunk:
    """Some rows of a record batch: the text bytes and where documents start."""

    def __init__(self, batch: pa.RecordBatch, text: str):
        self.batch = batch
        column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = all_bytes[at[0] : at[-1]]
        self.offsets = at - at[0]

    def __len__(self) -> int:
        return self.batch.num_rows

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def text(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut record batches so that a chunk holds about ``limit`` bytes of text.

    A document is never cut: a longer one is a chunk of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            stop = min(stop, start + 4096)
            yield Chunk(batch.slice(start, stop - start), text)
            start = stop


def byte_class(members: Iterable[int]) -> np.ndarray:
    """A lookup table that is true at the given byte values."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Space and the control characters tab to carriage return.
SPACES = byte_class([0x20, *range(0x09, 0x0E)])


def words(chunk: Chunk, outside: np.ndarray = SPACES, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of bytes not in ``outside``."""
    data = chunk.bytes if data is None else data
    n = len(data)
    inside = ~outside[data]
    first = np.zeros(n + 1, bool)
    first[chunk.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    doc = np.searchsorted(chunk.offsets, start, "right") - 1
    return start, end, doc


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by differences of prefix sums."""
    up, down = _BYTES.get(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def gram_sums(hashes: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that give the hash of any run of words in constant time."""
    up, down = _GRAMS[which].get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return total, down


def gram_hashes(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of words ``start`` to ``end`` (exclusive), elementwise."""
    total, down = sums
    return mix((total[end] - total[start]) * down[start], seed)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as the signed integers that Spark has."""
    return x.view(np.int64)
