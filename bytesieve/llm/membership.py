"""A filter of bounded size for ids, so that wide rows nobody asks for never enter a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



BITS = 23


def bitmap(ids: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A bit per hash value that occurs: 2**bits bits (1 MiB), whatever the number of ids. Too many ids only make it
    pass more; whoever uses it must still compare exactly. Null ids are left out."""
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits))
    words = (ids.where(F.col(column).isNotNull())
             .select(slot.alias("slot"))
             .groupBy(F.floor(F.col("slot") / 32).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("bits")))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for word, value in words.toLocalIterator():
        out[word] = value
    return out


def _unused(columns: list[str], name: str) -> str:
    """A column name that none of the given ones equals, whatever their case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def without(rows: DataFrame, ids: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """rows whose `column` is not among ids (both exact; null stays). Only rows that share a bit of a bounded filter
    with some id are shuffled for the exact comparison: the filter is joined as at most 2**(bits - 6) rows, a size
    that does not depend on the data, so it may be broadcast. Columns of any name pass through."""
    word, held = _unused(rows.columns, "filter_word"), _unused(rows.columns, "filter_bits")
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits))
    words = (ids.where(F.col(column).isNotNull()).select(slot.alias("slot"))
             .groupBy(F.expr("cast(slot div 64 as int)").alias(word))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias(held)))
    marked = rows.withColumn(word, F.coalesce(F.expr(
        f"cast(pmod(xxhash64(cast(`{column}` as bigint)), {1 << bits}) div 64 as int)"), F.lit(-1))).join(
        F.broadcast(words), word, "left")
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(cast(`{column}` as bigint)), {1 << bits}) % 64 as int))")
    hit = F.coalesce(F.col(held).bitwiseAND(bit) != 0, F.lit(False))
    doubt = marked.where(hit).join(ids.select(column).distinct(), column, "left_anti")
    return marked.where(~hit).select(*[F.col(f"`{c}`") for c in rows.columns]).unionByName(
        doubt.select(*[F.col(f"`{c}`") for c in rows.columns]))


def slots(column: str, bits: int = BITS):
    """The expression to look up in a bitmap."""
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits)).cast("int")


def seen(words: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (words[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) == 1


__all__ = ["bitmap", "seen", "slots", "without"]
