"""Writers.  Each writes in parallel; none gathers data on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.functions import ordered as O
from bytesieve.operators import segments

EPOCH_COLUMNS = [
    "epoch", "train_loss", "train_accuracy", "train_f1", "val_loss", "val_accuracy", "val_f1",
    "val_precision", "val_recall", "val_fnr", "val_fpr",
]


def write_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet") -> None:
    """One folder per split."""
    writer = df.write.mode("overwrite").partitionBy(split)
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)


def write_record(df: DataFrame, path: str) -> None:
    """Evaluation records, a JSON object per line, all that are given."""
    df.write.mode("overwrite").json(path)


def append_epochs(df: DataFrame, path: str) -> None:
    """Append per-epoch rows; absent metrics are written as 0."""
    cols = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in df.columns else F.lit(0).alias(c) for c in EPOCH_COLUMNS]
    df.select(*cols).write.mode("append").csv(path, header=True)


def write_ordered(df: DataFrame, path: str, key: str = "stream_id", idx: str = "idx") -> None:
    """Segments in output order, each with its byte offset."""
    segments.ordered_rows(segments.placed(df, key, idx), key, idx).write.mode("overwrite").parquet(path)


def after_offset(df: DataFrame, resume: DataFrame, key: str = "stream_id") -> DataFrame:
    """Rows at or past each output's resume offset; rows without one are all kept."""
    marks = O.null_safe_join(df.select(key).distinct(), resume.select(key, "resume_offset"), [key], "left").select(
        key, F.coalesce("resume_offset", F.lit(0)).alias("resume_offset"))
    return segments.lookup(df, marks, [key], ["offset"]).where(F.col("offset") >= F.col("resume_offset"))


def append_after(df: DataFrame, resume: DataFrame, path: str, key: str = "stream_id") -> None:
    after_offset(df, resume, key).write.mode("append").parquet(path)
