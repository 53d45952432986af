"""Byte-level BPE over the documents table."""

from __future__ import annotations

import public_tokenizers

from bytesieve.llm import byte_bpe
from bytesieve.llm.tables import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op6_byte_bpe(spark, sf_dir):
    return byte_bpe.encoded(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                            public_tokenizers.PATTERN, with_ids=False)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLES: dict[str, str] = {}
