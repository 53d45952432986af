"""Toxicity by logistic regression over hashed words, word pairs and skip-grams, learned by the follow-the-regularised-
leader proximal method: every coordinate has its own learning rate and an L1 penalty that leaves most weights at exactly
zero, so the weights that are broadcast are a short list of (bucket, weight), never longer than the number of buckets.

Words are runs of letters and digits, A-Z as a-z; every byte beyond ASCII counts as a letter. A feature counts once per
document. Labels, language, source and id are never looked at."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm import labelled
from bytesieve.llm.words import Words, mixed, slices

U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    skips: tuple[int, ...] = (1, 2)
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.5
    epochs: int = 3
    rows: int = 20000
    folds: int = 5
    cut: float = 0.5


def grams(column, bits: int, skips: tuple[int, ...]):
    """(row, bucket) arrays of the words, then of the pairs at each distance (1: neighbours, 2: one word between)."""
    w = Words(column, _LETTER)
    shift = U(64 - bits)
    row = w.row_of()
    yield row, (w.hashes >> shift).astype(np.int64)
    for d in skips:
        same = np.flatnonzero(row[:-d] == row[d:])
        h = mixed(mixed(w.hashes[same] + U(d)) * U(0xD1342543DE82EF95) + w.hashes[same + d])
        yield row[same], (h >> shift).astype(np.int64)


def fit(rows, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets in order, their weights, and the bias. Without rows the bias is that of an even chance."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    zb = nb = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def offset():
        return -zb / ((s.beta + nb ** 0.5) / s.alpha)

    rng = np.random.default_rng(11)
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            y, at, _ = rows[i]
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + offset(), -30, 30)))
            g = p - y
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha
            z[at] = zi + g - step * w
            n[at] = ni + g * g
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb ** 0.5) / s.alpha * offset(), nb + g * g
    w = weight(z, n)
    at = np.flatnonzero(w)
    return at, w[at], float(offset())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", s: Settings = Settings()):
    """The sparse model learned from at most `s.rows` labelled documents outside the held-out fold."""

    def features(column):
        parts = list(grams(column, s.bits, s.skips))
        row, bucket = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return labelled.summed(row, bucket, len(column), 1 << s.bits)

    return fit(labelled.training_rows(docs, labels, label, features, s.folds, s.rows, False), s)


def scored(docs: DataFrame, model, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, score (probability of label 1), predicted (1 if score >= cut). A null or empty
    text gets the bias alone; null ids stay null; repeated rows are scored alike."""
    sparse = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sparse.value
        dense = np.zeros(1 << s.bits, np.float32)
        dense[at] = w
        for batch in (part for whole in batches for part in slices(whole, 2)):
            rows, buckets = [], []
            for row, bucket in grams(batch.column(2), s.bits, s.skips):
                hit = np.flatnonzero(dense[bucket])
                rows.append(row[hit])
                buckets.append(bucket[hit])
            row, bucket, _ = labelled.summed(np.concatenate(rows), np.concatenate(buckets), batch.num_rows, 1 << s.bits)
            z = np.bincount(row, dense[bucket], batch.num_rows) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= s.cut).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), labelled.held_out(id_col, s.folds).alias("held_out"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(
        of, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
