"""Language-model scores of the documents table."""

from __future__ import annotations

from bytesieve.llm import ngram_lm
from bytesieve.llm.tables import read


def op10_ngram_lm(spark, sf_dir):
    return ngram_lm.learned_and_scored(read(spark, sf_dir, "documents"))


QUERIES = {"op10_ngram_lm": op10_ngram_lm}
ORACLES: dict[str, str] = {}
