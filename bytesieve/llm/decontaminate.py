"""Benchmark texts inside documents, by spaced seeds.

A seed is a fixed mask over consecutive words: some positions count, the others are ignored. Hashes of the counted
words at every place of both sides are joined; a document and an item that agree on a seed are compared word by word
around the hit, so that substituted words inside a passage cost a mismatch and not the match. Several masks of different
shape make it unlikely that substitutions meet a counted position of every mask at every place.

Documents are read once. A filter of fixed size that holds the items' seed hashes leaves at the scan what surely is
no hit; around what passes, the word hashes of the region go along, so the texts themselves are never shuffled. The join
is on hashes, exact, and dealt out by adaptive execution where one passage is in very many documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytesieve.llm.memory import released
from bytesieve.llm.tables import stored
from bytesieve.llm.words import Words, mixed, slices

U = np.uint64
BITS = 24
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Settings:
    """masks: counted positions (1) of each seed. matched: least share of equal words over the aligned stretch.
    shortest: least number of equal words; an item of fewer must be found whole. covered: least share of the item's words
    that the stretch, or several of a region together, must match. run: so many equal words in one stretch do for an item
    of any length."""

    masks: tuple[str, ...] = ("11111111", "1101101101011", "11010011101011")
    matched: float = 0.8
    shortest: int = 10
    covered: float = 0.5
    run: int = 50

    def least(self, words):
        """Equal words that an item of so many words needs at least."""
        return np.minimum(self.shortest, words)


def seeds(h: np.ndarray, rows: np.ndarray, masks: tuple[str, ...], whole: tuple[int, ...] = ()):
    """(place, seed hash) arrays of all masks over word hashes, then of the whole runs of so many words; a seed stays
    within its row."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    for number, mask in [*enumerate(masks), *((100 + n, "1" * n) for n in whole)]:
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        s = np.full(n, number + 1, np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                s = s * U(0xD1342543DE82EF95) + h[i:i + n]
        at = np.flatnonzero(row[:n] == row[len(mask) - 1:len(mask) - 1 + n])
        yield at, mixed(s[at])


def _item_rows(items: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(item, words: word hashes as bytes, hashes: distinct seed hashes). An item shorter than every mask has one hash,
    that of all its words."""
    shortest = min(len(m) for m in s.masks)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            w = Words(batch.column(1), LETTER, True)
            found = list(seeds(w.hashes, w.rows, s.masks))
            words, hashes = [], []
            for a, b in zip(w.rows[:-1], w.rows[1:], strict=True):
                words.append(w.hashes[a:b].tobytes())
                own = [h[(at >= a) & (at < b)] for at, h in found]
                if 0 < b - a < shortest:
                    own = [h for _, h in seeds(w.hashes[a:b], np.array([0, b - a]), (), (int(b - a),))]
                hashes.append(np.unique(np.concatenate(own)).view(np.int64) if own else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()),
                                              pa.array(hashes, pa.list_(pa.int64()))], names=["item", "words", "hashes"])

    return items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        of, "item long, words binary, hashes array<long>")


def _filter(hashes: DataFrame) -> np.ndarray:
    """2**BITS bits (2 MiB) with a bit for every seed hash, however many there are."""
    slot = F.shiftrightunsigned("hash", 64 - BITS)
    words = hashes.select(slot.alias("slot")).groupBy(F.expr("cast(slot / 32 as int)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("bits"))
    out = np.zeros(1 << (BITS - 5), np.uint32)
    for word, value in words.toLocalIterator():
        out[word] = value
    return out


def regions(docs: DataFrame, bits, id_col: str, text_col: str, s: Settings, margin: int, whole: tuple[int, ...] = ()) -> DataFrame:
    """(doc, begin, words, hashes): stretches of documents around seeds that pass the filter, `margin` words to either
    side, overlapping ones united. begin is the stretch's first word, hashes the seeds that passed."""

    @released
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            w = Words(batch.column(1), LETTER, True)
            places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for at, h in seeds(w.hashes, w.rows, s.masks, whole):
                slot = (h >> U(64 - BITS)).astype(np.int64)
                hit = np.flatnonzero(bits.value[slot >> 5] >> (slot & 31).astype(np.uint32) & np.uint32(1))
                places.append(at[hit])
                hashes.append(h[hit])
            place, h = np.concatenate(places), np.concatenate(hashes)
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, h = place[order], h[order]
            row = np.searchsorted(w.rows, place, "right") - 1
            low = np.maximum(place - margin, w.rows[row])
            high = np.minimum(place + margin, w.rows[row + 1])
            new = np.r_[True, (row[1:] != row[:-1]) | (low[1:] > high[:-1])]
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(place))
            ids = batch.column(0).take(pa.array(row[start]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(low[start] - w.rows[row[start]]),
                 pa.array([w.hashes[low[a]:high[b - 1]].tobytes() for a, b in zip(start, stop, strict=True)], pa.binary()),
                 pa.array([np.unique(h[a:b]).view(np.int64) for a, b in zip(start, stop, strict=True)],
                          pa.list_(pa.int64()))], names=["doc", "begin", "words", "hashes"])

    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        of, "doc long, begin long, words binary, hashes array<long>")


PAIRS = 1 << 20


def diagonals(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Equal words on every diagonal: entry d + len(item) - 1 counts the places with doc[d + j] == item[j]. Memory is linear
    in both lengths: words that both hold often are counted by a convolution, the others pair by pair in blocks."""
    n, m = len(doc), len(item)
    counts = np.zeros(max(0, n + m - 1), np.int64)
    values, at = np.unique(item, return_inverse=True)
    where = np.searchsorted(values, doc)
    where[where == len(values)] = 0
    hit = np.flatnonzero(values[where] == doc)
    hit = hit[np.argsort(where[hit], kind="stable")]
    mine = np.argsort(at, kind="stable")
    in_doc, in_item = (np.bincount(x, minlength=len(values)) for x in (where[hit], at))
    ends_doc, ends_item = np.cumsum(in_doc), np.cumsum(in_item)
    heavy = np.flatnonzero(in_doc * in_item > 1 << 14)
    size = 1 << max(1, n + m).bit_length()
    for v in heavy:
        a, b = np.zeros(size), np.zeros(size)
        a[hit[ends_doc[v] - in_doc[v]:ends_doc[v]]] = 1
        b[m - 1 - mine[ends_item[v] - in_item[v]:ends_item[v]]] = 1
        counts += np.rint(np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), size)[:len(counts)]).astype(np.int64)
    light = np.ones(len(values), bool)
    light[heavy] = False
    hit = hit[light[where[hit]]]
    each = in_item[where[hit]]
    done = np.cumsum(each)
    low = 0
    while low < len(hit):  # blocks of about PAIRS pairs
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + PAIRS, "right")))
        size_, own = each[low:high], where[hit[low:high]]
        nth = np.arange(size_.sum()) - np.repeat(np.cumsum(size_) - size_, size_)
        j = mine[np.repeat(ends_item[own] - in_item[own], size_) + nth]
        counts += np.bincount(np.repeat(hit[low:high], size_) - j + m - 1, minlength=len(counts))
        low = high
    return counts


def best_overlap(doc: np.ndarray, item: np.ndarray, s: Settings) -> tuple[int, int, int]:
    """(first word, end, equal words) of the best stretch on which item and doc agree in place with at least the share
    s.matched; (0, 0, 0) if there is none. Diagonals are tried from the fullest on, and none but the one tried is held."""
    counts, least = diagonals(doc, item), s.least(len(item))
    lines = np.flatnonzero(counts >= max(1, least))
    lines = lines[np.argsort(-counts[lines], kind="stable")]

    def stretch(line: int):
        """(start, end, the item's equal places) of a diagonal."""
        a, b = max(0, line), min(len(doc), line + len(item))
        same = doc[a:b] == item[a - line:b - line]
        # the longest stretch of which at least the share `matched` is equal: for each end the earliest fitting begin
        gain = np.concatenate([[0.0], np.cumsum(same - s.matched)])
        begins = np.searchsorted(-np.minimum.accumulate(gain), -gain - 1e-9)
        end = int(np.argmax(np.arange(len(gain)) - begins))
        begin = int(begins[end])
        place = np.flatnonzero(same[begin:end]) + begin
        return (a + int(place[0]), a + int(place[-1]) + 1, place + a - line) if len(place) else (0, 0, place)

    best = (0, 0, 0)
    for k in lines.tolist():
        if counts[k] <= best[2]:
            break
        start, end, place = stretch(k - len(item) + 1)
        if len(place) > best[2]:
            best = (start, end, len(place))
    if not least <= best[2] < min(s.run, s.covered * len(item)):
        return best
    # words put in or left out: stretches of several diagonals near the best one, each place of the item counted once
    low, high, _ = best
    got = np.zeros(len(item), bool)
    parts = []
    for k in lines.tolist():
        start, end, place = stretch(k - len(item) + 1)
        if len(place) >= least and start <= best[1] + len(item) and end >= best[0] - len(item):
            parts.append((-len(place), start, end, k))
    for _, start, end, k in sorted(parts):
        place = stretch(k - len(item) + 1)[2]
        if not got[place].all():
            got[place] = True
            low, high = min(low, start), max(high, end)
            if got.all():
                break
    return (low, high, int(got.sum())) if got.sum() >= s.covered * len(item) else best


def leaks(docs: DataFrame, items: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, start_word, end_word, n_equal, item_words): one row per document and item for the best overlap that
    has at least s.shortest equal words, and s.run equal words in one stretch or the share s.covered of the item's words. An
    item of fewer than s.shortest words is found where a document has all of them in a row.

    Words are runs of letters and digits, capitals of Latin-1 as small letters. Null and empty texts and null ids match nothing. Rows that repeat
    an id count together, the best overlap stays. Long and repetitive texts take memory in proportion to their words."""
    known = stored(_item_rows(items, item_id, item_text, s), "items")
    length = (F.octet_length("words") / 8).cast("int")
    shortest = min(len(m) for m in s.masks)
    # at most as many lengths as the shortest mask has places
    margin, whole = known.agg(F.max(F.octet_length("words")), F.collect_set(F.when(length.between(1, shortest - 1), length))).first()
    schema = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                           T.StructField("equal", T.LongType())])
    hashes = known.select("item", F.explode("hashes").alias("hash"))
    bits = docs.sparkSession.sparkContext.broadcast(_filter(hashes))
    near = stored(regions(docs, bits, id_col, text_col, s, (margin or 0) // 8 + 20, tuple(sorted(whole))).withColumn(
        "region", F.xxhash64("doc", "begin", "words")), "regions")
    met = near.select("doc", "begin", "region", F.explode("hashes").alias("hash")).join(hashes, "hash").select(
        "doc", "begin", "region", "item").distinct()

    @F.pandas_udf(schema)
    def compared(words, item):
        import pandas as pd

        return pd.DataFrame([best_overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), s)
                             for x, y in zip(words, item, strict=True)], columns=["start", "end", "equal"])

    found = (met.join(near.select("doc", "begin", "region", "words"), ["doc", "begin", "region"])
             .join(known.dropDuplicates(["item", "words"]).select("item", F.col("words").alias("other")), "item")
             .select("doc", "item", "begin", (F.octet_length("other") / 8).cast("long").alias("item_words"),
                     compared("words", "other").alias("o")))
    found = found.where((F.col("o.equal") >= F.least(F.lit(s.shortest), "item_words")) & (
        F.col("o.equal") >= F.least(F.lit(float(s.run)), s.covered * F.col("item_words"))))
    best = found.groupBy("doc", "item").agg(F.max(F.struct(
        F.col("o.equal").alias("equal"), (-(F.col("begin") + F.col("o.start"))).alias("first"),
        (F.col("begin") + F.col("o.end")).alias("end"), "item_words")).alias("b"))
    return best.select("doc", "item", (-F.col("b.first")).alias("start_word"), F.col("b.end").alias("end_word"),
                       F.col("b.equal").alias("n_equal"), F.col("b.item_words").alias("item_words"))
