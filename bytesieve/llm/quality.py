"""Quality by supervised subword embeddings: a document is the mean of learned vectors of its words and of the
character n-grams inside and at the borders of its words, all hashed into one table; softmax over two classes; plain
stochastic gradient descent in numpy.

Scoring needs one number per bucket only, the vector's product with the difference of the two output rows: the mean of
vectors and the output are linear. That table (2**bits single-precision numbers, 1 MiB) is what is broadcast.

Case and punctuation count as written; labels, language, source and id are never looked at."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm import labelled
from bytesieve.llm.memory import released
from bytesieve.llm.words import Words, hashed, mixed, powers, slices

U = np.uint64
_AS_IS = mixed(np.arange(256, dtype=np.uint64) + U(0x777))
_AS_IS[list(range(0x09, 0x0E))] = _AS_IS[0x20]
_GAP = np.zeros(256, np.int8)
_GAP[[0x20, *range(0x09, 0x0E)]] = 1


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    grams: tuple[int, ...] = (2, 4)
    size: int = 12
    epochs: int = 6
    rate: float = 1.0
    rows: int = 6000
    sample_bytes: int = 192 << 20
    folds: int = 5
    cut: float = 0.3


def subwords(column, bits: int, grams: tuple[int, ...]):
    """Buckets of the words, of the words that repeat the one before (all in one bucket, a word pair written as a
    back-reference), then of the character n-grams of each length: (row, bucket) arrays. An n-gram may begin or end with
    the white space beside a word but holds none inside."""
    w = Words(column)
    shift = U(64 - bits)
    row, h = w.row_of(), hashed(w.data, w.starts, w.ends, _AS_IS)
    yield row, (h >> shift).astype(np.int32)
    again = row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])]
    yield again, np.full(len(again), 17, np.int32)
    data, offsets = w.data, w.offsets
    n = len(data)
    if not n:
        return
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_AS_IS[data] * up[:n], out=total[1:])
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    gaps = np.zeros(len(lead) + 1, np.int32)
    np.cumsum(_GAP[data[lead]], out=gaps[1:])
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(np.searchsorted(lead, offsets)))
    lead = np.append(lead, n)
    for g in grams:
        m = len(lead) - g
        if m <= 0:
            continue
        ok = row[:m] == row[g - 1:g - 1 + m]
        if g > 2:
            ok &= gaps[g - 1:g - 1 + m] == gaps[1:m + 1]
        i = np.flatnonzero(ok)
        h = mixed((total[lead[i + g]] - total[lead[i]]) * down[lead[i]] + U(g))
        yield row[i], (h >> shift).astype(np.int32)


def fit(rows, s: Settings) -> tuple[np.ndarray, float]:
    """One number per bucket, and the bias. Without rows of both classes every score is the share of label 1 (a half
    without rows)."""
    y = np.array([r[0] for r in rows], np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return np.zeros(1 << s.bits, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / s.size, 1 / s.size, (1 << s.bits, s.size)).astype(np.float32)
    out, bias = np.zeros((2, s.size), np.float32), np.zeros(2, np.float32)
    steps, done = s.epochs * len(rows), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            label, at, value = rows[i]
            rate = np.float32(s.rate * (1 - done / steps))
            done += 1
            part = value / max(value.sum(), 1)
            vectors = table[at]
            mean = part @ vectors if len(at) else np.zeros(s.size, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * np.float32(0.1) * p
            if len(at):
                table[at] = vectors - (rate * len(at) ** 0.5) * np.outer(part, back)
    return (table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", s: Settings = Settings()):
    """The model learned, in one task, from at most `s.rows` labelled documents outside the held-out fold, and no more of
    them than `s.sample_bytes` of features."""

    def features(column):
        parts = list(subwords(column, s.bits, s.grams))
        row, bucket = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return labelled.summed(row, bucket, len(column), 1 << s.bits)

    def packed(rows) -> bytes:
        weights, bias = fit(rows, s)
        return np.append(weights.astype(np.float64), bias).tobytes()

    model = np.frombuffer(labelled.fitted(docs, labels, label, features, s.folds, s.rows, s.sample_bytes, packed))
    return model[:-1].astype(np.float32), float(model[-1])


def _scores(column, weights: np.ndarray, bias: float, s: Settings) -> np.ndarray:
    n = len(column)
    total, count = np.zeros(n), np.zeros(n)
    for row, bucket in subwords(column, s.bits, s.grams):
        total += np.bincount(row, weights[bucket], n)
        count += np.bincount(row, minlength=n)
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def scored(docs: DataFrame, model, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, score (probability of label 1), predicted (1 if score >= cut). A null or empty
    text has no features and gets the bias alone; null ids stay null; repeated rows are scored alike."""
    weights = docs.sparkSession.sparkContext.broadcast(model[0])
    bias = model[1]

    @released
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, 1 << 19)):
            score = _scores(batch.column(2), weights.value, bias, s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= s.cut).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), labelled.held_out(id_col, s.folds).alias("held_out"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(
        of, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model, s: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches the cut; null and empty texts are judged by the
    bias alone."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]
    where = docs.columns.index(text_col)

    @released
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, where, 1 << 19)):
            keep = _scores(batch.column(where), weights.value, bias, s) >= s.cut
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(of, docs.schema)
