"""Near-copies over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytesieve.llm.near_copies import near_copies
from bytesieve.llm.tables import read

PERCENT = 85


def op3_near_copies(spark, sf_dir):
    found = near_copies(read(spark, sf_dir, "documents"), percent=PERCENT)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.col("component").alias("component_id"), "kept")


QUERIES = {"op3_near_copies": op3_near_copies}
ORACLES: dict[str, str] = {}
