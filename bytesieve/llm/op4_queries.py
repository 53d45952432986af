"""Toxicity scores of the documents table."""

from __future__ import annotations

from bytesieve.llm import toxicity
from bytesieve.llm.tables import read


def op4_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
