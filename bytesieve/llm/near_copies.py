"""Near-copies of texts by bottom-k sketches.

One hash function orders all word shingles; a document keeps the k smallest. Inverted lists of retained values bring
documents together, the union sketch of two documents estimates their similarity, and the exact Jaccard similarity of
the full shingle sets decides.

Two documents of similarity s share a given one of the smallest values of their union with probability s, so the lists
of the `listed` smallest retained values miss a pair with probability (1 - s) ** listed. The union-sketch filter drops one
whose estimate is `DEVIATIONS` deviations too low. `missed` gives the chance of both together: 7.3e-09 at 0.85 and 1.0e-07 at
0.80 with 10 of 64 values.
Lists of up to `short` documents give all their pairs. The documents of longer lists (a passage that many share, a large
group of copies) go a second way that misses nothing: of all shingles of such a document the rarest n - ceil(s n) + 1
must hold one that a partner has, so only those are listed. What still is a long list there holds documents that mostly
are copies of each other: each is compared with one pivot, the members that the pivot does not tie together are
compared in blocks of bounded size. Nothing is capped, and no list is gathered whole."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytesieve.llm.components import components
from bytesieve.llm.membership import bitmap, seen, slots
from bytesieve.llm.memory import released
from bytesieve.llm.tables import Scratch, stored, tasks
from bytesieve.llm.words import shingle_sets, slices

DEVIATIONS = 7
SKETCH = "id long, n long, key binary, sketch array<long>"


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, width: int) -> DataFrame:
    """Per row: id, n (size of the shingle set), key (128 bits of the whole set; null without words), sketch (the k
    smallest hashes as signed numbers, in unsigned order)."""

    @released
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n, keys, lows = [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                lows.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(lows, pa.list_(pa.int64()))], names=["id", "n", "key", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        of, SKETCH)


def shingle_rows(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(id, items: the whole sorted shingle set as bytes) of the wanted ids, hashed anew from the texts: texts of other
    rows are left at the scan but for chance hits of a bounded filter."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "id"))

    @released
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(seen(bits.value, batch.column(2).to_numpy(zero_copy_only=False))))
            for part in slices(batch, 1):
                items = [s.tobytes() for s in shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.binary())], names=["id", "items"])

    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        slots(id_col).alias("slot")).mapInArrow(of, "id long, items binary")
    return rows.join(wanted.select("id").distinct(), "id", "left_semi")


def lists(post: DataFrame) -> DataFrame:
    """Postings of values that more than one document has, with the length of the list."""
    size = post.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    return post.join(size, "v")


def short_pairs(post: DataFrame, short: int, percent: int) -> DataFrame:
    """Pairs within short lists whose sizes allow the similarity."""
    own = post.where(F.col("m") <= short)
    a, b = (own.select("v", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    return a.join(b, "v").where("a < b").where(
        f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")


@F.pandas_udf(T.DoubleType())
def union_estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity by the union sketch: of the values up to the last that both sketches are known to, the share in
    both. A sketch of fewer than its k values is the whole set and known to the end."""
    out = np.empty(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = np.asarray(x, np.int64).view(np.uint64), np.asarray(y, np.int64).view(np.uint64)
        k = max(len(x), len(y))
        u, c = np.unique(np.concatenate([x, y]), return_counts=True)
        out[i] = (c[:k] == 2).sum() / max(1, min(k, len(u)))
    return pd.Series(out)


def _overlap(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


@F.pandas_udf(T.LongType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets."""
    return pd.Series([_overlap(x, y) if len(x) and len(y) else 0 for x, y in zip(a, b, strict=True)], dtype="int64")


def linked(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    return (pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
            .join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
            .select("a", "b", (F.octet_length("x") / 8).cast("long").alias("nx"),
                    (F.octet_length("y") / 8).cast("long").alias("ny"), overlap("x", "y").alias("both"))
            .where(f"100 * both >= {percent} * (nx + ny - both)").select("a", "b"))


def rare_postings(items: DataFrame, percent: int) -> DataFrame:
    """(v, id, n, lone): the rarest shingles of each set, as many as must meet one of any partner; lone: how many of the
    set nobody else has, which is low for the centre of a group."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n), pa.int64()),
                 pa.array(np.concatenate(sets or [np.zeros(0, np.int64)])), pa.array(np.repeat(n, n))],
                names=["id", "v", "n"])

    every = items.select("id", "items").mapInArrow(of, "id long, v long, n long")
    # one shuffle serves both the counts and their join
    every = every.repartition(tasks(items.sparkSession), "v")
    df = every.groupBy("v").agg(F.count("*").alias("df"))
    rank = Window.partitionBy("id").orderBy("df", "v")
    ranked = every.join(df, "v").select(
        "v", "id", "n", "df", F.row_number().over(rank).alias("at"),
        F.sum((F.col("df") == 1).cast("long")).over(Window.partitionBy("id")).alias("lone"))
    return ranked.where(f"df > 1 and at <= n - ceil({percent} * n / 100) + 1").select("v", "id", "n", "lone")


def block_links(post: DataFrame, items: DataFrame, roots: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of long lists that their pivot does not tie together. A list's members are dealt into blocks, those outside
    the pivot's component into further blocks; each pair of blocks is one bounded group that compares exactly by
    matrix products and emits links only."""
    held = post.join(roots.withColumnRenamed("root", "held"), "id", "left").select(
        "v", "id", "pivot", "m", F.coalesce("held", "id").alias("root"))
    pivots = roots.select(F.col("id").alias("pivot"), F.col("root").alias("top"))
    held = held.join(pivots, "pivot", "left").withColumn("out", F.col("root") != F.coalesce("top", "pivot"))
    outer = held.groupBy("v").agg(F.sum(F.col("out").cast("long")).alias("outs")).where("outs > 0")
    held = held.join(outer, "v")
    cut = lambda n: F.ceil(F.col(n) / block).cast("long")
    to = lambda n: F.pmod(F.xxhash64("id"), cut(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), cut(n) - 1))
    members = held.select("v", "id", "root", to("m").alias("mine"), each("outs").alias("theirs"), F.lit(False).alias("out"))
    outs = held.where("out").select("v", "id", "root", each("m").alias("mine"), to("outs").alias("theirs"),
                                    F.lit(True).alias("out"))
    rows = members.unionByName(outs).join(items, "id")

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        o, i = pdf[pdf.out], pdf[~pdf.out]
        if not len(o) or not len(i):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x, y = ([np.frombuffer(s, np.uint64) for s in p["items"]] for p in (o, i))
        nx, ny = (np.array([len(s) for s in z]) for z in (x, y))
        rx, ry = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
        values, at = np.unique(np.concatenate(x + y), return_inverse=True)
        ax, ay = at[:len(rx)], at[len(rx):]
        both = np.zeros((len(x), len(y)), np.float32)
        for low in range(0, len(values), 4096):
            p, q = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
            s = (ax >= low) & (ax < low + 4096)
            p[rx[s], ax[s] - low] = 1
            s = (ay >= low) & (ay < low + 4096)
            q[ry[s], ay[s] - low] = 1
            both += p @ q.T
        both = both.astype(np.int64)
        ok = (100 * both >= percent * (nx[:, None] + ny[None, :] - both)) & (
            o["root"].to_numpy()[:, None] != i["root"].to_numpy()[None, :])
        s, t = np.nonzero(ok)
        return pd.DataFrame({"a": o["id"].to_numpy()[s], "b": i["id"].to_numpy()[t]})

    return rows.groupBy("v", "mine", "theirs").applyInPandas(of, "a long, b long")


def least_estimate(percent: int, k: int) -> float:
    """What the union sketch must reach: the estimate may be off by some deviations of a share of k draws."""
    return percent / 100 - DEVIATIONS * math.sqrt(percent / 100 * (1 - percent / 100) / k)


def missed(percent: int, k: int = 64, listed: int = 10) -> float:
    """Chance, at most, that a pair exactly at the threshold shares none of the listed values or fails the estimate."""
    p, least = percent / 100, least_estimate(percent, k)
    return (1 - p) ** listed + sum(math.comb(k, i) * p ** i * (1 - p) ** (k - i) for i in range(k + 1) if i / k < least)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5,
                k: int = 64, listed: int = 10, short: int = 16, block: int = 256) -> DataFrame:
    """Per row of docs: id, n (shingles), component (smallest id reachable over links), kept (id is that smallest).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles; a text
    of fewer words has its whole word sequence as the only shingle. A null, empty or blank text has n = 0 and is linked
    with nothing. Rows of equal sets are one class, whatever their number. Rows that repeat an id are one document with
    several texts. A row with a null id has component null and is kept. An empty table gives no rows."""
    with Scratch(docs.sparkSession) as scratch:
        return stored(_near_copies(docs, id_col, text_col, percent, width, k, listed, short, block, scratch.stored), "near")


def _near_copies(docs, id_col, text_col, percent, width, k, listed, short, block, stored) -> DataFrame:
    made = stored(sketches(docs, id_col, text_col, k, width), "sketches")
    classes = made.where("id is not null and key is not null").groupBy("key").agg(
        F.min("id").alias("id"), F.min("n").alias("n"), F.count("*").alias("copies"))
    first = made.alias("m").join(classes.alias("c"), ["key", "id"], "left_semi").dropDuplicates(["id", "key"])
    first = stored(first.select("id", "n", "sketch"), "classes")
    post = stored(lists(first.select("id", "n", F.explode(F.slice("sketch", 1, listed)).alias("v"))), "lists")
    pairs = short_pairs(post, short, percent)
    crowd = stored(post.where(F.col("m") > short).select("id").distinct(), "crowd")
    crowd_sets = stored(shingle_rows(docs, id_col, text_col, width, crowd).join(
        first.select("id"), "id", "left_semi"), "crowd-sets")
    rare = stored(lists(stored(rare_postings(crowd_sets, percent), "rare-postings")), "rare")
    long = rare.where(F.col("m") > short)
    centre = long.groupBy("v").agg(F.min(F.struct("lone", "id")).alias("c")).select("v", F.col("c.id").alias("pivot"))
    long = stored(long.join(centre, "v"), "long")
    spokes = long.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    pairs = stored(pairs.unionByName(short_pairs(rare, short, percent)).unionByName(spokes).distinct(), "pairs")
    likely = (pairs.join(first.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a")
              .join(first.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
              .where(union_estimate("x", "y") >= least_estimate(percent, k)).select("a", "b"))
    likely = stored(likely, "likely")
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    links = stored(linked(likely, shingle_rows(docs, id_col, text_col, width, wanted), percent), "links")
    roots = components(links)
    if not long.isEmpty():
        more = stored(block_links(long, crowd_sets, roots, percent, block), "block-links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    tops = classes.join(roots, "id").select("key", "root")
    several = classes.where("copies > 1").select("key", F.col("id").alias("first"))
    tops = several.join(tops, "key", "full").select("key", F.coalesce("root", "first").alias("root"))
    return made.join(tops, "key", "left").select(
        "id", "n", F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component"),
        F.coalesce(F.col("id") == F.coalesce("root", "id"), F.lit(True)).alias("kept"))
