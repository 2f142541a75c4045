"""Vectorised views of text columns inside Arrow tasks.

Spark hands a task Arrow batches; these helpers read the UTF-8 bytes of a whole
run of documents as one numpy array, so that per-byte work is done once per run
of documents and not once per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; temporary arrays are 8 to 16 times this.
CHUNK_BYTES = 1 << 18


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about ``limit`` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def pieces(offsets: np.ndarray, overlap: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, begins and ends (in the batch's bytes) of pieces that are worked on together.

    A text of more than ``limit`` bytes is cut into pieces of its own, each of
    which repeats the first ``overlap`` bytes of the next, so that every window
    of ``overlap + 1`` bytes lies in exactly one piece.
    """
    for i, j in runs(offsets, limit):
        size = int(offsets[j] - offsets[i])
        if j - i > 1 or size <= limit + overlap:
            yield np.arange(i, j), offsets[i:j], offsets[i + 1 : j + 1]
        else:
            for at in range(int(offsets[i]), int(offsets[j]) - overlap, limit):
                yield np.array([i]), np.array([at]), np.array([min(at + limit + overlap, int(offsets[j]))])


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) | np.uint64(1)


def gram_hash(data: np.ndarray, size_log2: int, seed: int = 1) -> np.ndarray:
    """64-bit hashes of all byte strings of length ``2 ** size_log2``, by doubling."""
    h = byte_table(seed)[data]
    for k in range(size_log2):
        step = 1 << k
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * (byte_table(seed + 7 + k)[3]) + h[step:]
        h ^= h >> np.uint64(32)
    return mix(h)


class Spans:
    """Hashes of arbitrary byte ranges of one array, from prefix sums of base ** position."""

    _base, _powers, _inverse = 0xD6E8FEB86659FD93, None, None

    @classmethod
    def _tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls._powers is None or len(cls._powers) < n:
            size = max(n, CHUNK_BYTES + 4096)
            inverse = pow(cls._base, -1, 1 << 64)
            for name, base in (("_powers", cls._base), ("_inverse", inverse)):
                row = np.full(size, np.uint64(base))
                row[0] = 1
                setattr(cls, name, np.cumprod(row, dtype=np.uint64))
        return cls._powers, cls._inverse

    def __init__(self, data: np.ndarray, seed: int = 2):
        powers, self.inverse = self._tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_table(seed)[data] * powers[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
        return mix(h + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in ``data`` and the piece that it lies in; pieces are neighbours."""
    origin, until = int(begin[0]), int(end[-1])
    inside = ~_SPACE[data[origin:until]]
    edge = np.zeros(len(inside) + 1, bool)
    edge[begin - origin] = True
    edge[-1] = True
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | edge[1:-1]] if len(inside) else inside)
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:]) if len(inside) else inside) + 1
    # empty pieces share a begin with the next one: the last of them holds the word
    return starts + origin, ends + origin, np.searchsorted(begin, starts + origin, "right") - 1


def word_pieces(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``pieces``, but a long text is cut between words and nothing is repeated."""
    for i, j in runs(offsets, limit):
        begin, stop = int(offsets[i]), int(offsets[j])
        if stop == begin:
            continue
        if j - i > 1 or stop - begin <= limit:
            yield np.arange(i, j), offsets[i:j], offsets[i + 1 : j + 1]
            continue
        while begin < stop:
            cut = min(begin + limit, stop)
            while cut < stop and not len(near := np.flatnonzero(_SPACE[data[cut : cut + limit]])):
                cut = min(cut + limit, stop)
            cut = cut if cut >= stop else cut + int(near[0])
            yield np.array([i]), np.array([begin]), np.array([cut])
            begin = cut


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and hash of each word with A-Z in lower case, in order; a row's words come in one go."""
    held_rows, held = [], []
    for rows, begin, end in word_pieces(data, offsets):
        origin = int(begin[0])
        first, last, piece = words(data, begin, end)
        hashes = Spans(_LOWER[data[origin : int(end[-1])]])(first - origin, last - origin)
        if held and held_rows[-1][-1:] != rows[:1]:
            yield np.concatenate(held_rows), np.concatenate(held)
            held_rows, held = [], []
        if len(rows) == 1:  # perhaps a piece of a long text
            held_rows.append(np.full(len(hashes), rows[0]) if len(hashes) else np.zeros(0, np.int64))
            held.append(hashes)
            if not len(hashes):
                held_rows.pop(), held.pop()
            continue
        yield rows[piece], hashes
    if held:
        yield np.concatenate(held_rows), np.concatenate(held)
