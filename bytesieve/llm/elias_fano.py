"""Monotone integer sequences in Elias-Fano form, searched for many values at once, and files of arrays that are mapped
into memory instead of being read."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np
import pyarrow.fs as pafs

U = np.uint64
_ONE = U(1)
SPAN = 8  # words of 64 bits per directory entry


def _select_table() -> np.ndarray:
    """Place of the k-th set bit of a byte."""
    out = np.zeros((256, 8), np.uint8)
    for byte in range(256):
        at = [b for b in range(8) if byte >> b & 1]
        out[byte, :len(at)] = at
    return out


_PLACE = _select_table()


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits side by side in 64-bit words, with one spare word."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.uint64) * U(width)
        word, bit = (at >> U(6)).astype(np.int64), at & U(63)
        # words of neighbours overlap: add up by word, low and high parts apart
        values = values.astype(np.uint64)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[starts]] = np.bitwise_or.reduceat(values << bit, starts)
        over = np.flatnonzero(bit + U(width) > U(64))
        out[word[over] + 1] |= values[over] >> (U(64) - bit[over])
    return out


def unpacked(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The values at places `at`."""
    if width == 0:
        return np.zeros(len(at), np.uint64)
    pos = at.astype(np.uint64) * U(width)
    word, bit = (pos >> U(6)).astype(np.int64), pos & U(63)
    low = words[word] >> bit
    high = np.where(bit == 0, U(0), words[word + 1] << ((U(64) - bit) & U(63)))
    return (low | high) & U((1 << width) - 1)


def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Arrays of a rising sequence: low bits packed, high bits in unary, directories of ones and zeros."""
    n = len(values)
    values = values.astype(np.uint64)
    base = int(values[0]) if n else 0
    top = int(values[-1]) - base if n else 0
    width = max(0, (top // max(n, 1)).bit_length() - 1)
    values = values - U(base)
    ones = (values >> U(width)).astype(np.int64) + np.arange(n)
    size = ((int(ones[-1]) + 2 if n else 1) + 64 * SPAN) // (64 * SPAN) * SPAN
    bits = np.zeros(size * 8, np.uint8)
    spot, place = ones >> 3, (ones & 7).astype(np.uint8)
    if n:
        starts = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]])
        bits[spot[starts]] = np.bitwise_or.reduceat(np.left_shift(np.uint8(1), place), starts)
    words = bits.view(np.uint64)
    counts = np.bitwise_count(words).reshape(-1, SPAN).sum(1).astype(np.int64)
    before = np.cumsum(counts) - counts
    return {f"{name}.meta": np.array([n, width, top, base], np.uint64),
            f"{name}.low": packed(values & U((1 << width) - 1), width), f"{name}.high": words,
            f"{name}.ones": before, f"{name}.zeros": np.arange(len(counts), dtype=np.int64) * 64 * SPAN - before}


class Sequence:
    """A rising sequence over mapped arrays."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.width, self.top, self.base = (int(x) for x in arrays[f"{name}.meta"])
        self.low, self.high = arrays[f"{name}.low"], arrays[f"{name}.high"]
        self.ones, self.zeros = arrays[f"{name}.ones"], arrays[f"{name}.zeros"]

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Position of the k-th one, or zero, of the unary part."""
        directory = self.zeros if zeros else self.ones
        span = np.searchsorted(directory, k, "right") - 1
        left = (k - directory[span]).astype(np.int64)
        words = self.high.reshape(-1, SPAN)[span]
        if zeros:
            words = ~words
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (upto <= left[:, None]).sum(1)
        rows = np.arange(len(k))
        left -= np.where(word > 0, upto[rows, word - 1], 0)
        bytes_ = words[rows, word].view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(bytes_), axis=1, dtype=np.int64)
        byte = (upto <= left[:, None]).sum(1)
        left -= np.where(byte > 0, upto[rows, byte - 1], 0)
        return (span * SPAN + word) * 64 + byte * 8 + _PLACE[bytes_[rows, byte], left]

    def _run(self, pos: np.ndarray, ones: bool) -> np.ndarray:
        """Length of the run of ones, or of zeros, that starts at each position; 64 stands for 64 and more."""
        word, bit = pos >> 6, (pos & 63).astype(np.uint64)
        window = self.high[word] >> bit
        after = self.high[np.minimum(word + 1, len(self.high) - 1)]
        window |= np.where(bit == 0, U(0), after << ((U(64) - bit) & U(63)))
        if ones:
            window = ~window
        return np.bitwise_count((window & (~window + _ONE)) - _ONE).astype(np.int64)

    def pair(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places `at` and at the next ones."""
        first = self._select(at, False)
        gap = self._run(first + 1, False)
        second = first + 1 + gap
        far = np.flatnonzero(gap >= 64)
        if len(far):
            second[far] = self._select(at[far] + 1, False)
        out = []
        for pos, k in ((first, at), (second, at + 1)):
            out.append(((pos - k).astype(np.uint64) << U(self.width) | unpacked(self.low, self.width, k)) + U(self.base))
        return out[0], out[1]

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(at, False) - at).astype(np.uint64)
        return (high << U(self.width) | unpacked(self.low, self.width, at)) + U(self.base)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it is not there."""
        out = np.full(len(x), -1, np.int64)
        x = x - U(self.base)  # smaller values wrap round to beyond the top
        inside = np.flatnonzero(x <= U(self.top)) if self.n else np.zeros(0, np.int64)
        if not len(inside):
            return out
        x = x[inside]
        high = (x >> U(self.width)).astype(np.int64)
        low = x & U((1 << self.width) - 1)
        start = np.zeros(len(x), np.int64)
        later = high > 0
        start[later] = self._select(high[later] - 1, True) + 1
        size = self._run(start, True)
        at = start - high
        end = at + size
        far = np.flatnonzero(size >= 64)
        if len(far):
            end[far] = self._select(high[far], True) - high[far]
        open_ = np.flatnonzero(size > 0)
        while len(open_):
            seen = unpacked(self.low, self.width, at[open_])
            out[inside[open_[seen == low[open_]]]] = at[open_[seen == low[open_]]]
            open_ = open_[seen < low[open_]]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def save(files: pafs.FileSystem, path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: length of the head, the head, the arrays at multiples of 64 bytes."""
    at, head = 0, {}
    for key, a in arrays.items():
        head[key] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    with files.open_output_stream(path, compression=None) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(memoryview(np.ascontiguousarray(a)).cast("B"))
            out.write(bytes(-a.nbytes % 64))


def mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped. A file of a store without local paths is copied next to the task first; that copy
    has no name any more once it is mapped, so nothing stays behind."""
    files, path = pafs.FileSystem.from_uri(uri)
    copy = None
    if not isinstance(files, pafs.LocalFileSystem):
        fd, copy = tempfile.mkstemp()
        os.close(fd)
        pafs.copy_files(path, copy, source_filesystem=files, destination_filesystem=pafs.LocalFileSystem())
        path = copy
    whole = np.memmap(path, np.uint8, "r").view(np.ndarray)
    if copy:
        os.unlink(copy)
    size = int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8:8 + size].tobytes())
    out = {}
    for key, (kind, at, n) in head.items():
        begin = 8 + size + at
        out[key] = whole[begin:begin + n * np.dtype(kind).itemsize].view(kind)
    return out
