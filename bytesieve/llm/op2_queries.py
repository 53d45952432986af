"""Personal data of the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytesieve.llm import pii
from bytesieve.llm.tables import read


def op2_pii(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = pii.spans(docs, pii.train(docs))
    texts = F.transform(F.arrays_zip("kinds", "starts", "ends", "base"), lambda s: F.struct(
        F.concat_ws(":", s["kinds"], s["starts"], s["ends"]).alias("text"), s["base"].alias("base")))
    found = found.withColumn("each", texts)
    base = F.filter("each", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["text"].startswith(k + ":"))).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in pii.BASE),
        F.sha2(F.array_join(F.transform(base, lambda s: s["text"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("each", lambda s: s["text"]), ",").alias("spans"))


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
