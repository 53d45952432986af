"""Words of many texts at once: hashes over the raw UTF-8 bytes of an Arrow string column, without a Python string per
word. Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z count as a-z.

A text that is null has no words. Hashes are 64 bits wide and the same in every process."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _byte_values() -> np.ndarray:
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += U(32)
    return mixed(low + U(0x1234567))


_VALUE = _byte_values()
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(n - 1, PIECE).bit_length()
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = U(1)
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset:].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: int, size: int = 2 << 20):
    """The batch in runs of rows of about `size` bytes of text, so that work arrays stay small; a longer row is a run of
    its own."""
    _, offsets = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end (exclusive) in the bytes; no word crosses a row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge[:n])
    at = at[inside[at]]
    # a run ends at the next edge
    edges = np.flatnonzero(edge)
    return at, edges[np.searchsorted(edges, at) + 1]


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = _VALUE) -> np.ndarray:
    """64-bit hashes of byte ranges that lie in order and do not overlap, piece by piece."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE)))
        s, e = starts[i:j] - a, ends[i:j] - a
        size = int(e[-1])
        up, down = powers(size)
        total = np.empty(size + 1, np.uint64)
        total[0] = 0
        np.cumsum(value[data[a:a + size]] * up[:size], out=total[1:])
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mixed(out)


class Words:
    """hashes, starts and ends of all words of a column, and where each row's words begin (rows + 1 values)."""

    def __init__(self, column, is_word: np.ndarray = _SPACE, accents: bool = False):
        """accents: capital letters of Latin-1 count as small ones too."""
        self.data, self.offsets = buffers(column)
        if accents and len(self.data):
            at = np.flatnonzero(self.data[:-1] == 0xC3) + 1
            at = at[(self.data[at] >= 0x80) & (self.data[at] <= 0x9E) & (self.data[at] != 0x97)]
            self.data = self.data.copy()
            self.data[at] += 0x20
        self.starts, self.ends = bounds(self.data, self.offsets, is_word)
        self.hashes = hashed(self.data, self.starts, self.ends)
        self.rows = np.searchsorted(self.starts, self.offsets)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.rows))


def shingle_sets(column, width: int = 5):
    """Per row the sorted distinct hashes of its word shingles; the whole sequence where words are fewer; empty without
    words."""
    w = Words(column)
    h = w.hashes
    n = len(h)
    full = max(n - width + 1, 0)
    s = np.zeros(full, np.uint64)
    for j in range(width):
        s = s * U(0xD1342543DE82EF95) + mixed(h[j:j + full] + U(j + 1))
    s = mixed(s)
    for a, b in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
        k = b - a
        if k >= width:
            yield np.unique(s[a:b - width + 1])
        elif k:
            one = np.array([k], np.uint64)
            for x in h[a:b]:
                one = mixed(one * U(0xD1342543DE82EF95) + x)
            yield one
        else:
            yield s[:0]
