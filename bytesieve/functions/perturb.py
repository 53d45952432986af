"""Seeded random changes to numeric vectors.

The random numbers come from hashing (row key, position), so a row gets the
same change whatever partition or retry computes it.  The hash runs over whole
Arrow batches in numpy: a Spark lambda would be called once per element.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

from bytesieve import rules


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _unit(keys: np.ndarray, positions: np.ndarray, stream: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (positions.astype(np.uint64) + np.uint64(1))
        seed = seed + np.uint64(stream) * np.uint64(0xD1B54A32D192ED03)
    return (_mix(seed) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _normal(keys, positions, stream: int) -> np.ndarray:
    u = np.maximum(_unit(keys, positions, stream), 1e-12)
    v = _unit(keys, positions, stream + 1)
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


class _Batch:
    """A list array as flat values plus each value's row key and position."""

    def __init__(self, lists: pa.Array, keys: pa.Array):
        self.lengths = np.diff(np.asarray(lists.offsets, dtype=np.int64))
        self.absent = np.asarray(lists.is_null())
        self.x = np.asarray(lists.flatten().cast(pa.float64()), dtype=np.float64)
        self.rows = np.repeat(np.arange(len(lists)), self.lengths)
        first = np.cumsum(self.lengths) - self.lengths
        self.pos = np.arange(len(self.x)) - np.repeat(first, self.lengths)
        self.row_keys = np.asarray(keys, dtype=np.int64)
        self.keys = self.row_keys[self.rows]

    def per_row(self, stream: int) -> np.ndarray:
        return _unit(self.row_keys, np.full(len(self.row_keys), -1, dtype=np.int64), stream)[self.rows]

    def noise(self, x, std):
        return x + std * _normal(self.keys, self.pos, 1)

    def dropout(self, x, rate):
        return x * (_unit(self.keys, self.pos, 3) > rate)

    def shift(self, x):
        steps = np.floor(self.per_row(4) * (2 * rules.MAX_SHIFT + 1)) - rules.MAX_SHIFT
        return x + steps / 255.0

    def scale(self, x):
        low, high = rules.SCALE_RANGE
        return x * (low + (high - low) * self.per_row(5))

    def lists(self, x) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int32)
        made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.float32)))
        return pa.compute.if_else(pa.array(self.absent), None, made) if self.absent.any() else made


def augmented(features: Column, key: Column, strategy: Column, noise_level: float = rules.NOISE_LEVEL) -> Column:
    """Apply each row's named strategy, clipped to [0, 1]."""

    @F.arrow_udf("array<float>")
    def run(lists: pa.Array, keys: pa.Array, names: pa.Array) -> pa.Array:
        b = _Batch(lists, keys)
        name = np.asarray(names.to_pylist(), dtype=object)[b.rows]
        out = b.x.copy()
        for label, change in (
            ("noise", lambda: b.noise(b.x, noise_level)), ("dropout", lambda: b.dropout(b.x, rules.DROPOUT_RATE)),
            ("shift", lambda: b.shift(b.x)), ("scale", lambda: b.scale(b.x)),
            ("combined", lambda: b.dropout(b.noise(b.x, noise_level), rules.DROPOUT_RATE)),
        ):
            mine = name == label
            if mine.any():
                out = np.where(mine, change(), out)
        return b.lists(np.clip(out, 0.0, 1.0))

    return run(features, key, strategy)


def partly_shuffled(features: Column, key: Column, share: float = 0.1) -> Column:
    """Permute ``share`` of each vector's positions among themselves."""

    @F.arrow_udf("array<float>")
    def run(lists: pa.Array, keys: pa.Array) -> pa.Array:
        b = _Batch(lists, keys)
        out = b.x.copy()
        pick, deal = _unit(b.keys, b.pos, 6), _unit(b.keys, b.pos, 7)
        at = 0
        for n in b.lengths:
            k = int(n * share)
            if k > 1:
                chosen = at + np.argsort(pick[at:at + n], kind="stable")[:k]
                out[chosen] = b.x[chosen[np.argsort(deal[chosen], kind="stable")]]
            at += n
        return b.lists(out)

    return run(features, key)


def train_time(features: Column, key: Column, std: float = 0.01, rate: float = rules.DROPOUT_RATE,
               p_noise: float = 0.5, p_dropout: float = 0.3) -> Column:
    """Light noise on about half of the rows, dropout on about a third."""

    @F.arrow_udf("array<float>")
    def run(lists: pa.Array, keys: pa.Array) -> pa.Array:
        b = _Batch(lists, keys)
        x = np.where(b.per_row(8) > 1 - p_noise, np.clip(b.noise(b.x, std), 0.0, 1.0), b.x)
        return b.lists(np.where(b.per_row(9) > 1 - p_dropout, b.dropout(x, rate), x))

    return run(features, key)
