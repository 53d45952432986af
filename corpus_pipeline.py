"""The documents table made ready for training: stages that each take what the one before kept.

Every stage works on all rows it is given, handed to Python workers in small batches. The first four return the columns of documents; the last returns one row per
document with its token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesieve import session
from bytesieve.llm import byte_bpe, decontaminate, pii, quality, tables
from bytesieve.llm.membership import without
from bytesieve.llm.near_copies import near_copies
from bytesieve.llm.op6_queries import VOCABULARY

SIMILAR = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality model rejects go; it learns from the labelled rows outside the held-out fold."""
    tables.small_batches(spark)
    model = quality.train(docs, tables.read(spark, sf_dir, "labels"))
    return quality.kept(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, that with the smallest id; all rows without an id stay."""
    tables.small_batches(spark)
    gone = near_copies(docs, percent=SIMILAR).where("not kept").select(F.col("id").alias("doc_id")).distinct()
    return without(docs, gone, "doc_id")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    tables.small_batches(spark)
    found = decontaminate.leaks(docs, tables.read(spark, sf_dir, "benchmark"))
    gone = tables.stored(found.select(F.col("doc").alias("doc_id")).distinct(), "leaks")
    return without(docs, gone, "doc_id")


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text."""
    tables.small_batches(spark)
    made = pii.redacted(docs, pii.train(docs))
    return made.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of what they decode to."""
    tables.small_batches(spark)
    return byte_bpe.encoded(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("good_quality", good_quality), ("near_dedup", near_dedup), ("decontaminated", decontaminated),
          ("without_pii", without_pii), ("tokenized", tokenized)]

# No SQL can state learned scores, the tagger or the merges; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = session.new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
