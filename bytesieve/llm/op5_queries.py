"""Near-copies over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytesieve.llm.cap_filters import near_vectors
from bytesieve.llm.tables import read

COSINE = 0.95


def op5_cap_filters(spark, sf_dir):
    found = near_vectors(read(spark, sf_dir, "embeddings"), COSINE)
    return found.select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"),
                        F.col("component").alias("component_id"), "kept")


QUERIES = {"op5_cap_filters": op5_cap_filters}
ORACLES: dict[str, str] = {}
