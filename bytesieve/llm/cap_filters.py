"""Near-copies of vectors by spherical-cap filters.

Filter directions are pairs of random codewords, one for each half of a randomly rotated vector, so few codewords make
very many directions. A vector belongs to the caps of the `filters` directions nearest to it: its threshold is its own, so
every vector has the same number of filters, whatever the number of vectors. They are listed by sorting the codeword
scores of each half; the direction of ranks (i, j) is among the k best only if i * j <= k, counted from 1. Vectors meet in
the filters that they share, where their cosine is computed in double precision. The number of codewords gives a bounded
mean number of vectors per filter. Too many would cut the space finer than the wanted cosine (few dimensions, very many
vectors), so it is halved until, measured on a bounded sample of the vectors with partners placed at exactly that cosine,
at most `MISSED` of the pairs share no filter; at the end one filter holds all.

A pair counts in the smallest filter that it shares, so it counts once. Filters with many vectors are cut into blocks
and every two blocks meet in one bounded group; groups give each vector's number of links and a spanning forest, never
all pairs. Equal vectors are one class."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.components import components
from bytesieve.llm.tables import stored, tasks

BLOCK, PER_FILTER, FILTERS = 256, 64, 28
MISSED, SAMPLE, SAMPLE_NUMBERS = 0.001, 1000, 1_000_000


class Code:
    """Rotation and codewords for dimension d, about n vectors and pairs of cosine `least`; sample: unit vectors to measure
    the share of missed pairs on, random ones if there is none."""

    def __init__(self, d: int, n: int, filters: int = FILTERS, seed: int = 5, least: float = 0.95,
                 sample: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.d, self.even, self.most = d, d + d % 2, filters
        self.turn, _ = np.linalg.qr(rng.standard_normal((self.even, self.even)))
        half = self.even // 2
        words = max(16, 1 << math.ceil(math.log2(max(1.0, n * filters / PER_FILTER)) / 2))
        books = rng.standard_normal((2, words, half))
        books = books / np.linalg.norm(books, axis=2, keepdims=True) / math.sqrt(2)
        x, y = partners(rng, d, least, sample)
        self._use(books, words)
        while words > 1 and self.missed(x, y) > MISSED:
            words //= 2
            self._use(books, words if words ** 2 > filters else 1)
            words = self.words

    def _use(self, books: np.ndarray, words: int):
        self.words, self.books = words, books[:, :words].copy()
        ranks = [(i, j) for i in range(min(words, self.most)) for j in range(min(words, self.most // (i + 1)))]
        self.ranks = np.array(ranks).T if words ** 2 > self.most else np.indices((words, words)).reshape(2, -1)

    def missed(self, x: np.ndarray, y: np.ndarray) -> float:
        """Share of the pairs of unit vectors that have no filter in common."""
        lost = 0
        for low in range(0, len(x), 256):
            both = zip(self.filters(x[low:low + 256]), self.filters(y[low:low + 256]), strict=True)
            lost += sum(not len(np.intersect1d(p, q, True)) for p, q in both)
        return lost / max(1, len(x))

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per unit vector the sorted numbers of the filters nearest to it."""
        x = np.zeros((len(unit), self.even))
        x[:, :self.d] = unit
        x = x @ self.turn
        half, first = self.even // 2, int(self.ranks.max()) + 1
        a, b = x[:, :half] @ self.books[0].T, x[:, half:] @ self.books[1].T
        order_a, order_b = np.argsort(-a, axis=1)[:, :first], np.argsort(-b, axis=1)[:, :first]
        i, j = self.ranks
        score = np.take_along_axis(a, order_a, 1)[:, i] + np.take_along_axis(b, order_b, 1)[:, j]
        best = np.argsort(-score, axis=1)[:, :self.most]
        found = np.take_along_axis(order_a, i[best], 1) * self.words + np.take_along_axis(order_b, j[best], 1)
        return list(np.sort(found.astype(np.int64), axis=1))


def partners(rng, d: int, least: float, sample: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and for each a partner of that cosine: half of them in a random direction, half towards another vector
    of the sample."""
    x = rng.standard_normal((SAMPLE, d)) if sample is None or not len(sample) else sample
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.arange(2 * SAMPLE) % len(x)]
    away = np.concatenate([rng.standard_normal((SAMPLE, d)), x[rng.permutation(2 * SAMPLE)[:SAMPLE]]])
    for _ in range(2):
        away -= (away * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    ok = size[:, 0] > 1e-6
    x, away = x[ok], away[ok] / size[ok]
    least = min(1.0, max(-1.0, least))
    return x, least * x + math.sqrt(1 - least * least) * away


def _vectors(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def usable(embedding: str):
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(embedding, lambda v: v != 0), F.lit(False))


def filter_rows(classes: DataFrame, code: Code) -> DataFrame:
    """(filter, id, w, vec, all: the vector's filters) for every filter of every class."""
    sent = classes.sparkSession.sparkContext.broadcast(code)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                x = _vectors(part.column(2))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = own.filters(x)
                n = np.array([len(f) for f in found])
                at = np.repeat(np.arange(len(x)), n)
                for s in range(0, len(at), 20_000):
                    t = at[s:s + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(found)[s:s + 20_000]), part.column(0).take(pa.array(t)),
                         part.column(1).take(pa.array(t)), pa.array([x[i].tobytes() for i in t], pa.binary()),
                         pa.array([found[i].tobytes() for i in t], pa.binary())],
                        names=["filter", "id", "w", "vec", "every"])

    return classes.select("id", "w", "vec").mapInArrow(of, "filter long, id long, w long, vec binary, every binary")


def _earlier(lists: list[np.ndarray], other: list[np.ndarray], this: int) -> np.ndarray:
    """Whether two members share a filter before this one, for all pairs of the two lists."""
    a, b = ([f[:np.searchsorted(f, this)] for f in x] for x in (lists, other))
    na, nb = ([len(f) for f in x] for x in (a, b))
    values, at = np.unique(np.concatenate(a + b), return_inverse=True)
    p, q = np.zeros((len(a), len(values)), np.float32), np.zeros((len(b), len(values)), np.float32)
    p[np.repeat(np.arange(len(a)), na), at[:sum(na)]] = 1
    q[np.repeat(np.arange(len(b)), nb), at[sum(na):]] = 1
    return p @ q.T > 0


def group_links(keys, ids, w, vec, every, role, least: float):
    """Rows (a, b, links) of one group: links gained by a (b null), and forest links a-b."""
    this, i, j = keys
    left, right = (np.flatnonzero(role), np.flatnonzero(~role)) if i != j else (np.arange(len(ids)),) * 2
    if not len(left) or not len(right):
        return
    x = np.frombuffer(b"".join(vec[k] for k in left), np.float64).reshape(len(left), -1)
    y = x if i == j else np.frombuffer(b"".join(vec[k] for k in right), np.float64).reshape(len(right), -1)
    near = x @ y.T >= least
    if i == j:
        np.fill_diagonal(near, False)
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(rows):
        return
    near = near[np.ix_(rows, cols)]
    lists = [[np.frombuffer(every[k], np.int64) for k in side] for side in (left[rows], right[cols])]
    near &= ~_earlier(*lists, this)
    la, lb = ids[left[rows]], ids[right[cols]]
    gained = near @ w[right[cols]]
    for k in np.flatnonzero(gained):
        yield la[k], None, gained[k]
    if i != j:
        gained = near.T @ w[left[rows]]
        for k in np.flatnonzero(gained):
            yield lb[k], None, gained[k]
    parent: dict[int, int] = {}

    def top(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for k in range(len(la)):
        for m in np.flatnonzero(near[k]):
            a, b = top(la[k]), top(lb[m])
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield la[k], lb[m], 0


def met(rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Degree rows and forest links of all filters: (a, b, links)."""
    size = rows.groupBy("filter").agg(F.count("*").alias("m")).where("m > 1")
    rows = rows.join(size, "filter").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       (F.col("own") <= F.col("other")).alias("role"), "id", "w", "vec", "every")
    dealt = rows.repartition(tasks(rows.sparkSession), "filter", "i", "j").sortWithinPartitions("filter", "i", "j")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(out):
            a, b, n = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())],
                                              names=["a", "b", "links"])

        held = None
        out = []
        for batch in batches:
            table = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
            key = np.stack([table.column(k).to_numpy() for k in (0, 1, 2)], 1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            cut = [0, *cut.tolist()]
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                if high - low > 1:
                    out += run(table.slice(low, high - low), key[low])
                if len(out) > 20_000:
                    yield packed(out)
                    out = []
            held = table.slice(cut[-1]).combine_chunks().to_batches()[0]
        if held is not None and held.num_rows > 1:
            out += run(pa.Table.from_batches([held]), [held.column(k)[0].as_py() for k in (0, 1, 2)])
        if out:
            yield packed(out)

    def run(t: pa.Table, key):
        return list(group_links(tuple(int(k) for k in key), t.column("id").to_numpy(), t.column("w").to_numpy(),
                                t.column("vec").to_pylist(), t.column("every").to_pylist(),
                                np.array(t.column("role").to_pylist()), least))

    return dealt.mapInArrow(of, "a long, b long, links long")


def near_vectors(table: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
                 filters: int = FILTERS) -> DataFrame:
    """Per row: id, links (other rows linked directly), component (smallest id reachable, itself included), kept.

    Rows link whose cosine is at least `least`. Null, empty and zero vectors and those with null or non-finite
    components link with nothing; vectors of different lengths never link. Equal vectors link whatever their number. A
    row with a null id links with nothing, has component null and is kept; rows that repeat an id count each."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("ok", usable("vec") & F.col("id").isNotNull())
    classes = stored(rows.where("ok").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("w")), "vectors")
    links = None
    for d, n in sorted(map(tuple, classes.groupBy(F.size("vec").alias("d")).count().collect())):
        own = classes.where(F.size("vec") == d)
        some = own.orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // d))).select("vec").collect()
        x = np.array([r.vec for r in some])
        code = Code(d, n, filters, least=least, sample=x / np.linalg.norm(x, axis=1, keepdims=True))
        made = stored(filter_rows(own, code), "filters")
        one = met(made, least)
        links = one if links is None else links.unionByName(one)
    if links is None:
        links = rows.sparkSession.createDataFrame([], "a long, b long, links long")
    links = stored(links, "links")
    roots = components(links.where("b is not null").select("a", "b"))
    degree = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    classes = classes.join(degree, "id", "left").join(roots, "id", "left").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("root", "id").alias("root"))
    found = rows.where("ok").join(classes, "vec").select("id", "links", F.col("root").alias("component"))
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
