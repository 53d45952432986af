"""A bounded sample of labelled documents as sparse feature rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.memory import released
from bytesieve.llm.words import slices

# (row of the batch, bucket, value) of every feature
Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def held_out(id_col: str, folds: int):
    """Whether a row is kept from learning: crc32 of the id as text, modulo folds, is 0. False where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def _made(docs: DataFrame, labels: DataFrame, label: str, features: Features, folds: int, rows: int, with_values: bool):
    """(doc_id, y, buckets, vals) of at most `rows` labelled documents outside the held-out fold. With more labels than
    that the rows of smallest hashed id are taken: a uniform choice that no partitioning changes. A null or other label
    than 0 and 1 is none. Features are made where the texts are."""
    chosen = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds))
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id").select("y", "text", "doc_id")

    @released
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, 1 << 19)):
            row, bucket, value = features(batch.column(1))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            pick = [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array([bucket[s].astype(np.int32).tobytes() for s in pick], pa.binary()),
                 pa.array([value[s].astype(np.float32).tobytes() if with_values else b"" for s in pick], pa.binary())],
                names=["doc_id", "y", "buckets", "vals"])

    return texts.mapInArrow(of, "doc_id long, y int, buckets binary, vals binary")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, features: Features, folds: int, rows: int,
                  with_values: bool = True) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, values) of the rows of :func:`_made`, fetched: the bounded sample's sparse rows, each no longer
    than the number of buckets; values only where asked for."""
    made = _made(docs, labels, label, features, folds, rows, with_values).toArrow()
    got = sorted(zip(made["doc_id"].to_pylist(), made["y"].to_pylist(), made["buckets"].to_pylist(),
                     made["vals"].to_pylist(), strict=True), key=lambda r: r[:2])
    return [(y, np.frombuffer(b, np.int32), np.frombuffer(v, np.float32)) for _, y, b, v in got]


def fitted(docs: DataFrame, labels: DataFrame, label: str, features: Features, folds: int, rows: int, most_bytes: int,
           fit: Callable[[list[tuple[int, np.ndarray, np.ndarray]]], bytes]) -> bytes:
    """What `fit` makes of the rows of :func:`_made`, in one task: the driver gets the packed model alone. The task
    takes rows in the order of the hashed id until their features fill `most_bytes`, so long texts are bounded too."""

    @released
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            for i, y, b, v in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "y", "buckets", "vals")], strict=True):
                held += len(b) + len(v)
                if held <= most_bytes:
                    got.append((i, y, b, v))
        got.sort(key=lambda r: r[:2])
        model = fit([(y, np.frombuffer(b, np.int32), np.frombuffer(v, np.float32)) for _, y, b, v in got])
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    one = _made(docs, labels, label, features, folds, rows, True).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    made = one.mapInArrow(of, "model binary").first()
    return fit([]) if made is None else bytes(made["model"])


def summed(row: np.ndarray, bucket: np.ndarray, rows: int, buckets: int):
    """Distinct (row, bucket) in order, with how often each occurs."""
    key, count = np.unique(row.astype(np.int64) * buckets + bucket, return_counts=True)
    return key // buckets, key % buckets, count
