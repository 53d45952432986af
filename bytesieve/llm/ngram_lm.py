"""An n-gram language model in a trie of Elias-Fano levels.

Level 1 holds the words: their hashes as a rising sequence, so a word's place is its id, and their counts. Level n holds
for every context (the id of the node of its words in level n - 1) the words that follow it: rising context ids,
monotone pointers to where each context's successors begin, the successors in order, and per node the quantised smoothed
probability and the quantised count it has as a context. A word is looked up in the range of its context only.

Probabilities are interpolated with a Dirichlet prior: P(w | c) = (count(c w) + m P(w | shorter c)) / (count(c) + m).

Every level is cut by hash into as many files as there are shuffle partitions, built by as many tasks and written to the
shared folder; the driver sees one row per file. Tasks map the files and never read them whole. A task takes some
million tokens at a time, sorts them into distinct n-grams and looks those up in order, file after file: an n-gram that
is a third of all text is one look-up and one counted row per block. Counts travel as sorted, packed blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve import session
from bytesieve.llm import elias_fano
from bytesieve.llm.elias_fano import Sequence, packed, unpacked
from bytesieve.llm.tables import stored, tasks
from bytesieve.llm.words import Words, mixed, slices

U = np.uint64
END = U(0xE0D0E0D0E0D0E0D1)
BLOCK_TOKENS = 1_000_000
LOW, STEPS = -16.0, 255 / 16.0  # log10 probabilities in 255 steps
COUNT_STEPS = 4096.0


@dataclass(frozen=True)
class Settings:
    """order: longest n-gram. prior: strength m per level from 2 on. least: n-grams of a level counted less often are
    not stored (they back off, and their mass is lost), per level from 2 on; 1 stores all."""

    order: int = 3
    prior: tuple[float, ...] = (4.0, 2.0)
    least: tuple[int, ...] = (1, 1)
    folds: int = 10


def probability_code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round((np.log10(p) - LOW) * STEPS), 0, 255).astype(np.uint8)


def probability(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code / STEPS + LOW)


def count_code(c: np.ndarray) -> np.ndarray:
    return np.round(np.log10(c) * COUNT_STEPS).astype(np.uint16)


def count_of(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code / COUNT_STEPS)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers by byte plane, compressed; differences if they rise."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expanded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def grouped(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of shard, and where each shard's begin."""
    small = shard.astype(np.uint16) if shards < 1 << 16 else shard  # sixteen bits sort in linear time
    cut = np.zeros(shards + 1, np.int64)
    np.cumsum(np.bincount(shard, minlength=shards), out=cut[1:])
    return np.argsort(small, kind="stable"), cut


def distinct(keys: np.ndarray):
    """Distinct keys in order, a place of each, the number of each key's distinct key, and counts."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[starts], order[starts], back, np.diff(np.append(starts, len(keys)))


def spread(ctx: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    """The file of an n-gram. A context keeps to an eighth of the files, so even one that follows every word is
    dealt out."""
    wide = max(1, shards // 8)
    return ((mixed(ctx) % U(shards) + mixed(word + U(77)) % U(wide)) % U(shards)).astype(np.int64)


def word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64)


@dataclass
class Level:
    """Files of a level in order of shard, and the id of the first node of each."""

    files: list[str]
    base: np.ndarray
    total: int
    shards: int = field(init=False)

    def __post_init__(self):
        self.shards = len(self.files)

    def open(self, shard: int) -> dict[str, np.ndarray]:
        return elias_fano.mapped(self.files[shard])

    def by_shard(self, shard: np.ndarray):
        """(shard, places) for the shards that occur."""
        order, cut = grouped(shard, self.shards)
        for s in range(self.shards):
            if cut[s] < cut[s + 1] and self.files[s]:
                yield s, order[cut[s]:cut[s + 1]]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level 1: ids (-1: unknown) and counts of word hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for s, at in self.by_shard(word_shard(h, self.shards)):
            file = self.open(s)
            place = Sequence(file, "words").find(h[at])
            hit = place >= 0
            ids[at[hit]] = place[hit] + self.base[s]
            counts[at[hit]] = file["count"][place[hit]]
        return ids, counts

    def at(self, ids: np.ndarray, column: str) -> np.ndarray:
        """A column of nodes by id."""
        out = None
        for s, at in self.by_shard(np.searchsorted(self.base, ids, "right") - 1):
            got = self.open(s)[column][ids[at] - self.base[s]]
            if out is None:
                out = np.zeros(len(ids), got.dtype)
            out[at] = got
        return np.zeros(0, np.int64) if out is None else out

    def find(self, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: not stored) and probability codes of n-grams given by context id and word id, in order of both."""
        ids, codes = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx), np.uint8)
        for s, at in self.by_shard(spread(ctx, word, self.shards)):
            file = self.open(s)
            c, w = ctx[at], word[at]
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            nth = np.cumsum(np.r_[False, c[1:] != c[:-1]])
            rank = Sequence(file, "contexts").find(c[first])
            pointers = Sequence(file, "pointers")
            low, high = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            hit = np.flatnonzero(rank >= 0)
            low[hit], high[hit] = pointers.pair(rank[hit])
            low, high = low[nth], high[nth]
            live = np.flatnonzero(low < high)
            width, successors = int(file["width"][0]), file["successors"]
            while len(live):
                middle = (low[live] + high[live]) >> 1
                seen = unpacked(successors, width, middle)
                same = seen == w[live]
                found = live[same]
                ids[at[found]] = middle[same] + self.base[s]
                codes[at[found]] = file["probability"][middle[same]]
                less = seen < w[live]
                low[live[less]] = middle[less] + 1
                high[live[~less]] = middle[~less]
                live = live[~same]
                live = live[low[live] < high[live]]
        return ids, codes


@dataclass
class Model:
    tokens: int
    levels: list[Level]
    settings: Settings

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.tokens + 0.1 * (self.levels[0].total + 1))


class Block:
    """Some documents' tokens: the end token after the words of each."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        """rows: where each document's tokens begin, and their number at the end."""
        self.rows = rows
        self.words, _, self.token, _ = distinct(hashes)
        first = np.zeros(len(hashes) + 1, bool)
        first[rows] = True
        self.first = first[:-1]

    def ngrams(self, model: Model, upto: int):
        """Ids, counts, smoothed probabilities: arrays per token for the longest context of at most upto - 1 words, and
        for the last level looked at the distinct (context id, word id, P of the shorter context) of all tokens whose
        whole context is stored."""
        ids, counts = model.levels[0].words(self.words)
        count = counts[self.token]
        word = np.where(ids < 0, model.levels[0].total, ids)[self.token].astype(np.uint64)
        p = model.p1(count)
        node, weight = ids[self.token], count.astype(np.float64)
        last = None
        before, start = np.full(len(word), -1, np.int64), self.first.copy()
        before_weight = np.zeros(len(word))
        for n in range(2, upto + 1):
            before[1:], before_weight[1:] = node[:-1], weight[:-1]
            before[0] = -1
            usable = np.flatnonzero(~start & (before >= 0))
            bits = U(max(1, int(model.levels[0].total).bit_length()))
            if int(model.levels[n - 2].total).bit_length() + int(bits) > 64:
                raise OverflowError("more nodes than 64-bit keys can tell apart")
            key = before[usable].astype(np.uint64) << bits | word[usable]
            keys, pick, back, times = distinct(key)
            pick = usable[pick]
            ctx, w = keys >> bits, keys & ((U(1) << bits) - U(1))
            last = (ctx, w, times, p[pick], before_weight[pick])
            if n == upto and len(model.levels) < n:
                return p, count, last
            found, codes = model.levels[n - 1].find(ctx, w)
            prior = model.settings.prior[n - 2]
            shorter = prior * p[pick] / (before_weight[pick] + prior)
            value = np.where(found >= 0, probability(codes), shorter)
            p = p.copy()
            p[usable] = value[back]
            if n < model.settings.order:
                hit = found >= 0
                held = np.zeros(len(found))
                if hit.any():
                    held[hit] = count_of(model.levels[n - 1].at(found[hit], "count"))
                node, weight = np.full(len(word), -1, np.int64), np.zeros(len(word))
                node[usable], weight[usable] = found[back], held[back]
                start = start.copy()
                start[1:] |= self.first[:-1]
        return p, count, last


def blocks(batches: Iterator[pa.RecordBatch], text: int, size: int = BLOCK_TOKENS):
    """(block, rows of other columns) of about `size` tokens; a longer document is a block of its own."""
    held, parts, tokens = [], [], 0
    for batch in (part for whole in batches for part in slices(whole, text)):
        w = Words(batch.column(text))
        n = np.diff(w.rows)
        ends = np.cumsum(n + 1)
        h = np.full(len(w.hashes) + len(n), END, np.uint64)
        inside = np.ones(len(h), bool)
        inside[ends - 1] = False
        h[inside] = w.hashes
        held.append(h)
        parts.append((batch.select([i for i in range(batch.num_columns) if i != text]), n + 1))
        tokens += len(h)
        if tokens >= size:
            yield made(held, parts)
            held, parts, tokens = [], [], 0
    if parts:
        yield made(held, parts)


def made(held, parts):
    rows = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])
    return Block(np.concatenate(held), rows), [b for b, _ in parts]


def built(rows: DataFrame, build, shards: int, path: str) -> tuple[Level, int]:
    """A level from payload rows (shard, a, b, c): build(group, file) writes one file and returns (nodes, tokens)."""

    def of(key, table):
        arrays, tokens = build(table)
        files, base = pafs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
        name = f"{key[0].as_py()}-{uuid.uuid4().hex}"
        elias_fano.save(files, f"{base}/{name}", arrays)
        return pa.table({"shard": [key[0].as_py()], "file": [f"{path}/{name}"], "nodes": [len(arrays["count"])],
                         "tokens": [tokens]})

    out = stored(rows.groupBy("shard").applyInArrow(of, "shard long, file string, nodes long, tokens long"), "levels")
    got = {r.shard: r for r in out.collect()}
    nodes = np.array([got[s].nodes if s in got else 0 for s in range(shards)], np.int64)
    files = [got[s].file if s in got else "" for s in range(shards)]
    return Level(files, np.cumsum(nodes) - nodes, int(nodes.sum())), sum(r.tokens for r in got.values())


PAYLOAD = "shard long, a binary, b binary, c binary"


def payload(shard: np.ndarray, shards: int, *columns: np.ndarray) -> pa.RecordBatch | None:
    """A row per shard of the columns' values that fall to it; the first column is in order and goes as differences."""
    order, cut = grouped(shard, shards)
    out = [[], [], [], []]
    for s in range(shards):
        if cut[s] < cut[s + 1]:
            at = order[cut[s]:cut[s + 1]]
            first = columns[0][at]
            out[0].append(s)
            out[1].append(squeezed(np.diff(first, prepend=U(0))))
            for k in (1, 2):
                out[k + 1].append(squeezed(columns[k][at]) if k < len(columns) else b"")
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])],
                                      names=["shard", "a", "b", "c"])


def gathered(table: pa.Table):
    """Distinct keys of a shard's payloads, their summed counts, and the third column's value of each."""
    keys = np.concatenate([np.cumsum(expanded(x), dtype=np.uint64) for x in table["a"].to_pylist()])
    counts = np.concatenate([expanded(x) for x in table["b"].to_pylist()])
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sums = np.add.reduceat(counts[order], starts)
    third = table["c"].to_pylist()
    extra = np.concatenate([expanded(x) for x in third])[order][starts] if third[0] else None
    return keys[starts], sums, extra


def learn(texts: DataFrame, s: Settings = Settings()) -> Model:
    """The model of the texts in column `text` (null: empty): all words and n-grams of all rows are counted."""
    spark = texts.sparkSession
    shards, path = tasks(spark), session.new_path(spark, "trie")
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    texts = texts.select("text")

    def count_words(batches):
        for block, _ in blocks(batches, 0):
            yield payload(word_shard(block.words, shards), shards, block.words,
                          np.bincount(block.token, minlength=len(block.words)).astype(np.uint64))

    def build_words(table):
        keys, counts, _ = gathered(table)
        return elias_fano.encode(keys, "words") | {"count": counts.astype(np.int64)}, int(counts.sum())

    first, tokens = built(texts.mapInArrow(count_words, PAYLOAD), build_words, shards, path)
    model = Model(tokens, [first], s)
    for n in range(2, s.order + 1):
        if not model.levels[-1].total:
            break
        model.levels.append(_next_level(texts, model, n, shards, path))
    return model


def _next_level(texts: DataFrame, model: Model, n: int, shards: int, path: str) -> Level:
    sent = texts.sparkSession.sparkContext.broadcast(model)  # names of files, not their contents
    s = model.settings
    bits = U(max(1, int(model.levels[0].total).bit_length()))
    prior, least = s.prior[n - 2], s.least[n - 2]

    def count(batches):
        for block, _ in blocks(batches, 0):
            _, _, (ctx, w, times, shorter, _) = block.ngrams(sent.value, n)
            if len(ctx):
                yield payload(spread(ctx, w, shards), shards, ctx << bits | w, times, probability_code(shorter))

    def build(table):
        keys, counts, shorter = gathered(table)
        keep = counts >= least
        keys, counts, shorter = keys[keep], counts[keep].astype(np.float64), shorter[keep]
        ctx, w = keys >> bits, keys & ((U(1) << bits) - U(1))
        starts = np.flatnonzero(np.r_[len(ctx) > 0, ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, np.int64)
        contexts = ctx[starts]
        column = sent.value.levels[n - 2].at(contexts.astype(np.int64), "count")
        held = column.astype(np.float64) if n == 2 else count_of(column)
        whole = np.repeat(held, np.diff(np.r_[starts, len(ctx)]))
        p = np.minimum(1.0, (counts + prior * probability(shorter)) / (whole + prior))
        arrays = elias_fano.encode(contexts, "contexts")
        arrays |= elias_fano.encode(np.r_[starts, len(ctx)].astype(np.uint64), "pointers")
        arrays |= {"width": np.array([int(bits)], np.int64), "successors": packed(w, int(bits)),
                   "probability": probability_code(p), "count": count_code(counts)}
        return arrays, 0

    return built(texts.mapInArrow(count, PAYLOAD), build, shards, path)[0]


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null or empty text has the
    end token alone; unknown words back off to the smallest probability; ids may be null or repeated."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for block, others in blocks(batches, 2):
            p, count, _ = block.ngrams(own, len(own.levels))
            begin = block.rows[:-1]
            base = np.add.reduceat(np.log10(own.p1(count)), begin)
            score = np.add.reduceat(np.log10(p), begin)
            known = np.add.reduceat((count > 0).astype(np.int64), begin)
            ids = pa.concat_arrays([b.column(0) for b in others])
            held = pa.concat_arrays([b.column(1) for b in others])
            yield pa.RecordBatch.from_arrays(
                [ids, held, pa.array(np.diff(block.rows)), pa.array(known), pa.array(np.full(len(known), own.tokens)),
                 pa.array(base), pa.array(score)],
                names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), held_out(id_col, model.settings.folds).alias("held_out"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(
        of, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
            "score double")


def held_out(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds, is 0; false where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def learned_and_scored(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Learns from all rows that are not held out and scores all rows. Without rows to learn from every token is
    unknown."""
    model = learn(docs.where(~held_out(id_col, s.folds)).select(F.col(text_col).cast("string").alias("text")), s)
    return scored(docs, model, id_col, text_col)
