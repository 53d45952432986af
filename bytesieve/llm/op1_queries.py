"""Quality scores of the documents table."""

from __future__ import annotations

from bytesieve.llm import quality
from bytesieve.llm.tables import read


def op1_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
