"""Benchmark passages in the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytesieve.llm.decontaminate import leaks
from bytesieve.llm.tables import read


def op8_decontaminate(spark, sf_dir):
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "start_word", "end_word",
                        "n_equal", "item_words")


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES: dict[str, str] = {}
