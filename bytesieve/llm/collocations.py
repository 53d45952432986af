"""Phrases whose words come together more often than chance, by Rabin-Karp fingerprints.

A prefix polynomial over the word hashes of a batch gives the fingerprint of any n-gram in one subtraction. The shuffle
sums fingerprints level by level: a word pair is counted only where both words pass the filter of frequent words, a longer
phrase only where all its pairs pass the filter of frequent pairs. Filters may pass too much, never too little: they are
bitmaps with a slot per fingerprint, as large as what they hold asks for but never over `FILTER_BITS` bits.
The last pass meets the text: every occurrence of a fingerprint is compared, word by word, with the one its pointer shows,
unlike words under one fingerprint are told apart, and only phrases that passed become strings. Their counts are by text,
so no collision of fingerprints reaches the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytesieve.llm.tables import Scratch, stored, tasks
from bytesieve.llm.words import U, bounds, buffers, hashed, mixed, powers, slices

LONGEST = 5
FILTER_BITS = 27
_BREAK = np.zeros(256, bool)
_BREAK[[*range(0x0A, 0x0E), *b".,;:!?"]] = True
_IN_WORD = ~_BREAK
_IN_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Grams:
    """The words of a slice and the fingerprint of every n-gram of them; column 0 holds langs, column 1 texts."""

    def __init__(self, part: pa.RecordBatch, bits: int):
        """bits: width of fingerprints; less than 64 only to provoke collisions."""
        data, offsets = buffers(part.column(1))
        self.data = _LOWER[data]
        self.starts, self.ends = bounds(data, offsets, _IN_WORD)
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        piece = np.concatenate([[0], np.cumsum(_BREAK[data])])[self.starts] if len(data) else self.starts
        # rows and pieces in one number that changes wherever a phrase must end
        self.piece = piece + self.row
        langs = part.column(0).dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[self.row].astype(np.int64)
        seed = np.array([_text_hash(x) for x in self.langs] or [0], np.uint64)
        self.words = hashed(data, self.starts, self.ends)
        n = len(self.words)
        self.up, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * self.up[:n], out=self.total[1:])
        self.seed, self.drop = seed[self.lang] if n else self.words, U(64 - bits)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n-grams that start at the given words; each lang has its own."""
        h = (self.total[at + n] - self.total[at]) * self.down[at]
        return mixed(h + self.seed[at] + U(n)) >> self.drop

    def whole(self, n: int) -> np.ndarray:
        """Words at which an n-gram starts that ends in the same piece of the same row."""
        m = max(0, len(self.words) - n + 1)
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1:n - 1 + m])


def _text_hash(text: str) -> int:
    h = 0
    for b in text.encode("utf-8", "surrogatepass"):
        h = (h * 0x100000001B3 + b + 1) & ((1 << 64) - 1)
    return int(mixed(np.array([h], np.uint64))[0])


def _passes(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    slot = prints & U(len(bitmap) * 32 - 1)
    return (bitmap[(slot >> U(5)).astype(np.int64)] >> (slot & U(31)).astype(np.uint32)) & np.uint32(1) == 1


def bitmap(frequent: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """A bit per slot that a fingerprint of `frequent` (print) falls into: 16 bits each, rounded up, at most 2**most_bits
    in all (16 MiB by default), whatever their number. The driver receives the packed words in blocks."""
    bits = min(most_bits, max(16, (16 * frequent.count()).bit_length()))
    packed = (frequent.select(F.expr(f"print & {(1 << bits) - 1}L").alias("slot"))
              .groupBy(F.expr("cast(slot div 32 as int)").alias("word"))
              .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("bits"))
              .groupBy(F.expr("word div 4096").alias("block")).agg(F.collect_list(F.struct("word", "bits")).alias("held")))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for row in packed.select("held").toLocalIterator():
        word, value = zip(*row[0], strict=True)
        out[np.array(word)] = np.array(value, np.uint64).astype(np.uint32)
    return out


def _chains(grams: Grams, words: np.ndarray | None, pairs: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(n, starts) of the n-grams that the filters let pass: words, pairs of such words, longer ones of such pairs."""
    every = np.arange(len(grams.words))
    known = _passes(words, grams.prints(every, 1)) if words is not None else np.ones(len(every), bool)
    yield 1, np.flatnonzero(known)
    at = grams.whole(2)
    at = at[known[at] & known[at + 1]]
    if pairs is not None:
        at = at[_passes(pairs, grams.prints(at, 2))]
    yield 2, at
    linked = np.zeros(len(every) + 1, bool)
    linked[at] = True
    for n in range(3, LONGEST + 1):
        at = at[linked[at + n - 2]]
        yield n, at


def counted(docs: DataFrame, n: int, words: np.ndarray | None, least: int, bits: int) -> DataFrame:
    """(print, n) of the words or pairs that occur at least `least` times; each slice sends its sums."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for whole in batches for p in slices(whole, 1)):
            grams = Grams(part, bits)
            at = next(starts for m, starts in _chains(grams, known.value, None) if m == n)
            value, count = np.unique(grams.prints(at, n), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))],
                                             names=["print", "n"])

    return docs.mapInArrow(of, "print long, n long").groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _alike(grams: Grams, at: np.ndarray, shown: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-grams at `at` have, word for word, the bytes of those at `shown`."""
    ok = np.ones(len(at), bool)
    for j in range(n):
        a, b = at + j, shown + j
        size = grams.ends[a] - grams.starts[a]
        ok &= size == grams.ends[b] - grams.starts[b]
        i = np.flatnonzero(ok)
        reach = np.repeat(np.arange(len(i)), size[i])
        step = np.arange(len(reach)) - np.repeat(np.cumsum(size[i]) - size[i], size[i])
        unlike = grams.data[grams.starts[a][i][reach] + step] != grams.data[grams.starts[b][i][reach] + step]
        ok[i[np.unique(reach[unlike])]] = False
    return ok


def _phrase(grams: Grams, at: int, n: int) -> bytes:
    return b" ".join(grams.data[grams.starts[i]:grams.ends[i]].tobytes() for i in range(at, at + n))


def phrases(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, bits: int) -> DataFrame:
    """(lang, n, phrase, f): all n-grams that the filters let pass, by text; n = 0 holds the words of the lang."""
    context = docs.sparkSession.sparkContext
    first, second = context.broadcast(words), context.broadcast(pairs)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for whole in batches for p in slices(whole, 1)):
            grams = Grams(part, bits)
            lang = list(range(len(grams.langs)))
            size, text, many = [0] * len(lang), [b""] * len(lang), np.bincount(grams.lang, minlength=len(lang)).tolist()
            for n, at in _chains(grams, first.value, second.value):
                while len(at):
                    _, shown, group, count = np.unique(
                        grams.prints(at, n), return_index=True, return_inverse=True, return_counts=True)
                    ok = _alike(grams, at, at[shown][group], n) & (grams.lang[at] == grams.lang[at[shown]][group])
                    left = at[~ok]
                    if len(left):
                        count = np.bincount(group[ok], minlength=len(shown))
                    lang += grams.lang[at[shown]].tolist()
                    size += [n] * len(shown)
                    text += [_phrase(grams, i, n) for i in at[shown].tolist()]
                    many += count.tolist()
                    at = left  # unlike the one shown: a collision, dealt with in the next turn
            yield pa.RecordBatch.from_arrays(
                [pa.array([grams.langs[i] for i in lang], pa.string()), pa.array(size, pa.int32()),
                 pa.array(text, pa.binary()).cast(pa.string()), pa.array(many, pa.int64())], names=["lang", "n", "phrase", "f"])

    return docs.mapInArrow(of, "lang string, n int, phrase string, f long").groupBy("lang", "n", "phrase").agg(
        F.sum("f").alias("f"))


def frequencies(docs: DataFrame, least: int, bits: int = 64, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of the phrases of 1 to 5 words with f >= least, and (lang, total) words of each lang."""
    with Scratch(docs.sparkSession) as scratch:
        ones = bitmap(scratch.stored(counted(docs, 1, None, least, bits), "words"), filter_bits)
        twos = bitmap(scratch.stored(counted(docs, 2, ones, least, bits), "pairs"), filter_bits)
        found = stored(phrases(docs, ones, twos, bits).where(f"n = 0 or f >= {least}"), "phrases")
    return (found.where("n > 0").select("lang", "phrase", F.col("n").alias("words"), "f"),
            found.where("n = 0").select("lang", F.col("f").alias("total")))


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score): phrases of at least two words by their lowest-scoring cut. Products are
    exact decimals: counts may have 15 digits."""
    many = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = many.select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"),
                       F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("rest"))
    f = found.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(f.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(f.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= 1 << 16 else totals, "lang")
    digits = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("up", digits("a") * digits("total") * F.lit(1000).cast("decimal(4,0)")).withColumn(
        "down", digits("l") * digits("r")).withColumn("score", F.expr("up div down"))
    best = F.min(F.struct("score", "k", "l", "r", "total")).alias("best")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(best).select(
        "lang", "phrase", "words", "a", "best.l", "best.r", F.col("best.total").alias("n"), "best.score")


def covered(found: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of those that lie in a longer one with at least `percent` hundredths of their occurrences."""
    longer = found.where("words > 2").select("lang", "words", "f", F.split("phrase", " ").alias("w"))
    inner = longer.select("lang", "f", "w", "words", F.explode(F.expr("sequence(2, words - 1)")).alias("m")).select(
        "lang", "f", "w", "m", F.explode(F.expr("sequence(1, words - m + 1)")).alias("at"))
    inner = inner.select("lang", F.expr("array_join(slice(w, at, m), ' ')").alias("phrase"), F.col("f").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own = found.where("words > 1").select("lang", "phrase", "f")
    return own.join(most, ["lang", "phrase"]).where(f"100 * longer >= {percent} * f").select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, percent: int = 100,
                 first: int | None = 2000, bits: int = 64, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score: each lang's first phrases by score and a (descending) and phrase.

    A-Z count as a-z; texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs, and no
    phrase crosses a piece. Candidates have 2 to 5 words and at least `least` occurrences; one that lies in a longer
    candidate with `percent` hundredths of its occurrences is dropped. first: ranks to keep (None: all).
    A null text is empty, a null lang is `und`, one with the lang und. Repeated rows count each time. Ties of score and a
    go by the phrase's bytes. Long texts are a slice of their own. An empty table gives no rows; other columns are not
    looked at."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    found, totals = frequencies(rows, least, bits, filter_bits)
    best = stored(scored(found, totals).join(covered(found, percent), ["lang", "phrase"], "left_anti"), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if first is not None:  # before one task ranks a lang, parts of it drop what cannot be among its first
        deal = F.pmod(F.xxhash64("phrase"), F.lit(tasks(docs.sparkSession)))
        best = best.withColumn("deal", deal).withColumn("at", F.row_number().over(
            Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("at") <= first).drop("deal", "at")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")
