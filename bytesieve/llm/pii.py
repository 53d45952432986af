"""Personal data in texts: spans that fixed rules find, and further spans that a character model tags.

The model is a bidirectional LSTM over characters with a conditional random field on top, trained in numpy from labelled
spans: windows of a bounded sample of the texts with the spans the rules and two secret patterns find there, and copies
of such windows into which made-up values were written. Gates are piecewise linear so that tagging all characters of all
texts stays cheap. Texts are cut into overlapping windows; each character takes its tag from the window in which it lies
farthest from an edge, and spans are the runs of equal tags of the whole text, wherever windows ended."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.memory import released
from bytesieve.llm.words import buffers, slices

# Kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"AKIA[0-9A-Z]{16}|(?:password|token|key) ?[=:] ?\"?[0-9A-Za-z+/_-]{8,}\"?")
_DIGIT = re.compile("[0-9]")

F32 = np.float32
LETTER, PAD, SYMBOLS = 128, 129, 130
_SYMBOL = np.minimum(np.arange(256), LETTER).astype(np.uint8)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches around each @, left to right; time is linear in the text however long its words are."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        free = max(free, at + 1) if begin == at else free
        if begin < at:
            m = _DOMAIN.match(text, at + 1)
            if m:
                out.append((begin, m.end()))
                free = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed rules, in order of kind and start, in code points."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


@dataclass(frozen=True)
class Settings:
    hidden: int = 8
    window: int = 256
    overlap: int = 32
    train_window: int = 64
    documents: int = 3000
    windows: int = 6000
    steps: int = 400
    batch: int = 192
    rate: float = 0.02
    batch_windows: int = 1536
    shortest: int = 7


class Tagger:
    """Weights of the model; tags are 0 for none and 1 + kind. From one kind the tags lead to itself or to none."""

    def __init__(self, s: Settings, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, tags = s.hidden, len(KINDS) + 1
        self.s = s
        self.weights = {"bias": np.zeros((tags, 1), F32), "trans": np.zeros((tags, tags), F32)}
        for d in "fb":
            self.weights[f"in_{d}"] = (rng.standard_normal((4 * h, SYMBOLS)) * 0.5).astype(F32)
            self.weights[f"in_{d}"][h:2 * h] += F32(1)
            self.weights[f"re_{d}"] = (rng.standard_normal((4 * h, h)) * 0.3).astype(F32)
            self.weights[f"out_{d}"] = (rng.standard_normal((tags, h)) * 0.5).astype(F32)
        self.allowed = np.eye(tags, dtype=bool)
        self.allowed[0] = self.allowed[:, 0] = True
        self.tuned = False

    # A gate is clip(z / 5 + 1/2); input tables hold that scaling and offset when `gates` made them.
    def gates(self, d: str):
        h = self.s.hidden
        scale = np.concatenate([np.full(3 * h, 0.2, F32), np.ones(h, F32)])[:, None]
        offset = np.concatenate([np.full(3 * h, 0.5, F32), np.zeros(h, F32)])[:, None]
        return self.weights[f"in_{d}"] * scale + offset, self.weights[f"re_{d}"] * scale

    def run(self, ids: np.ndarray, d: str, keep: bool = False):
        """Emission parts (window, tags, batch) of one direction for symbols (window, batch); with keep also all
        inner values."""
        h, (t, b) = self.s.hidden, ids.shape
        table, again = self.gates(d)
        out = self.weights[f"out_{d}"]
        state, cell = np.zeros((h, b), F32), np.zeros((h, b), F32)
        z, y = np.empty((4 * h, b), F32), np.empty((4 * h, b), F32)
        parts, kept = np.empty((t, len(out), b), F32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            np.matmul(again, state, out=z)
            np.take(table, ids[k], axis=1, out=y, mode="clip")
            z += y
            raw = z.copy() if keep else None
            gate, new = z[:3 * h], z[3 * h:]
            np.clip(gate, 0, 1, out=gate)
            np.tanh(new, out=new)
            old = cell.copy() if keep else None
            was = state
            np.multiply(z[h:2 * h], cell, out=cell)
            cell += z[:h] * new
            top = np.tanh(cell)
            state = z[2 * h:3 * h] * top
            np.matmul(out, state, out=parts[k])
            if keep:
                kept.append((k, raw, z.copy(), old, top, was, state))
        return parts, kept

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        e = self.run(ids, "f")[0]
        e += self.run(ids, "b")[0]
        e += self.weights["bias"]
        return e

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tags (window, batch) of symbols (window, batch)."""
        e, a = self.emissions(ids), self.weights["trans"]
        t, tags, b = e.shape
        score = e[0].copy()
        scores, stay = np.empty((t, tags, b), F32), np.empty((t, tags, b), bool)
        scores[0] = score
        into, own, back = a[0, 1:, None], np.diag(a)[1:, None], a[1:, 0][:, None]
        for k in range(1, t):
            start, hold = score[0] + into, score[1:] + own
            np.greater_equal(hold, start, out=stay[k, 1:])
            np.maximum(hold, start, out=start)
            left = (score[1:] + back).max(0)
            none = score[0] + a[0, 0]
            np.greater_equal(none, left, out=stay[k, 0])
            score[1:] = start
            np.maximum(none, left, out=score[0])
            score += e[k]
            scores[k] = score
        tag = score.argmax(0)
        out, every = np.empty((t, b), np.uint8), np.arange(b)
        for k in range(t - 1, 0, -1):
            out[k] = tag
            moved = np.flatnonzero(~stay[k, tag, every])
            if len(moved):
                left = moved[tag[moved] == 0]
                tag[moved] = 0
                if len(left):
                    tag[left] = 1 + (scores[k - 1][1:, left] + back).argmax(0)
        out[0] = tag
        return out

    def gradients(self, ids: np.ndarray, gold: np.ndarray):
        """Loss and its gradients for gold tags (window, batch)."""
        h, (t, b) = self.s.hidden, ids.shape
        w = self.weights
        runs = {d: self.run(ids, d, True) for d in "fb"}
        e = runs["f"][0] + runs["b"][0] + w["bias"]
        a = np.where(self.allowed, w["trans"], F32(-1e4))
        tags = len(a)

        def lse(x, axis):
            m = x.max(axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for k in range(1, t):
            alpha[k] = lse(alpha[k - 1][:, None] + a[:, :, None], 0) + e[k]
        for k in range(t - 2, -1, -1):
            beta[k] = lse(a[:, :, None] + (e[k + 1] + beta[k + 1])[None], 1)
        total = lse(alpha[-1], 0)
        post = np.exp(alpha + beta - total)
        cols = np.arange(b)
        trans = np.zeros_like(a)
        for k in range(1, t):
            trans += np.exp(alpha[k - 1][:, None] + a[:, :, None] + (e[k] + beta[k])[None] - total).sum(2)
            np.add.at(trans, (gold[k - 1], gold[k]), F32(-1))
        loss = total.sum()
        for k in range(t):
            loss -= e[k][gold[k], cols].sum()
            post[k][gold[k], cols] -= 1
        loss -= a[gold[:-1], gold[1:]].sum()
        grads = {"bias": post.sum((0, 2))[:, None], "trans": np.where(self.allowed, trans, 0)}
        scale = np.concatenate([np.full(3 * h, 0.2, F32), np.ones(h, F32)])[:, None]
        for d in "fb":
            again, out = self.gates(d)[1], w[f"out_{d}"]
            gi, gr, go = np.zeros_like(w[f"in_{d}"]), np.zeros_like(again), np.zeros_like(out)
            dstate, dcell = np.zeros((h, b), F32), np.zeros((h, b), F32)
            for k, raw, z, old, top, was, state in reversed(runs[d][1]):
                go += post[k] @ state.T
                ds = out.T @ post[k] + dstate
                i, f, o, g = (z[x * h:(x + 1) * h] for x in range(4))
                dcell = dcell + ds * o * (1 - top * top)
                dz = np.concatenate([dcell * g, dcell * old, ds * top, dcell * i * (1 - g * g)])
                dz[:3 * h] *= (raw[:3 * h] > 0) & (raw[:3 * h] < 1)
                dcell = dcell * f
                dstate = again.T @ dz
                gr += dz @ was.T
                one = np.zeros((SYMBOLS, b), F32)
                one[ids[k], cols] = 1
                gi += dz @ one.T
            grads[f"in_{d}"], grads[f"re_{d}"], grads[f"out_{d}"] = gi * scale, gr * scale, go
        return loss / (t * b), {k: g.astype(F32) / F32(b) for k, g in grads.items()}

    def fit(self, ids: np.ndarray, gold: np.ndarray, seed: int = 9) -> None:
        """Adam over random batches of windows (rows of ids and gold)."""
        s, rng = self.s, np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.weights.items()} for _ in range(2))
        for step in range(1, s.steps + 1):
            pick = rng.integers(0, len(ids), s.batch)
            _, grads = self.gradients(ids[pick].T, gold[pick].T)
            rate = s.rate * min(1.0, 2 * (1 - step / (s.steps + 1)))
            for k, g in grads.items():
                g = np.clip(g, -5, 5)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.weights[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(F32)
        self.weights["trans"] = np.where(self.allowed, self.weights["trans"], F32(-1e4))
        self.tuned = True


def symbols(column) -> tuple[np.ndarray, np.ndarray]:
    """One symbol per code point of all rows, and where rows begin."""
    data, offsets = buffers(column)
    lead = (data & 0xC0) != 0x80
    begins = np.concatenate([[0], np.cumsum(lead)])[offsets]
    return _SYMBOL[data[lead]], begins


def tagged(model: Tagger, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A tag per symbol of all rows."""
    s = model.s
    out = np.zeros(len(ids), np.uint8)
    if not model.tuned or not len(ids):
        return out
    step, half = s.window - s.overlap, s.overlap // 2
    size = np.diff(begins)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - s.window) // step)), 0)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start, end = begins[row] + nth * step, begins[row + 1]
    place = np.arange(s.window)
    for low in range(0, len(row), s.batch_windows):
        pick = slice(low, low + s.batch_windows)
        at = start[pick, None] + place
        inside = at < end[pick, None]
        given = np.where(inside, ids[np.minimum(at, len(ids) - 1)], PAD)
        tags = model.decode(np.ascontiguousarray(given.T)).T
        first, final = nth[pick, None] == 0, (nth[pick] + 1 == count[row[pick]])[:, None]
        inside &= (first | (place >= half)) & (final | (place < s.window - half))
        out[at[inside]] = tags[inside]
    return out


def runs(tags: np.ndarray, begins: np.ndarray):
    """(row, tag, start, end) of runs of equal tags, offsets within the row."""
    edge = np.ones(len(tags), bool)
    edge[1:] = tags[1:] != tags[:-1]
    edge[begins[:-1][begins[:-1] < len(tags)]] = True
    at = np.flatnonzero(edge)
    stop = np.append(at[1:], len(tags))
    hit = tags[at] > 0
    at, stop = at[hit], stop[hit]
    row = np.searchsorted(begins, at, "right") - 1
    return zip(row.tolist(), tags[at].tolist(), (at - begins[row]).tolist(), (stop - begins[row]).tolist(), strict=True)


def added(text: str, own: list[tuple[int, int, int]], found, shortest: int) -> list[tuple[int, int, int]]:
    """Tagged runs that the rules have not covered: trimmed of blanks and closing marks, long enough, with a digit or
    an @ inside."""
    out = []
    for tag, a, b in found:
        while a < b and text[a].isspace():
            a += 1
        while a < b and (text[b - 1].isspace() or text[b - 1] in ".,;:!?"):
            b -= 1
        if b - a >= shortest and (("@" in text[a:b]) or _DIGIT.search(text, a, b)) and not any(
                x < b and a < y for _, x, y in own):
            out.append((tag - 1, a, b))
    return out


def _value(kind: int, rng) -> str:
    pick = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    low, digits, up = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    if kind == 0:
        return f"{pick(low, rng.integers(3, 9))}{rng.choice(['.', '_', ''])}{pick(digits, rng.integers(0, 4))}@" \
               f"{pick(low, rng.integers(3, 8))}.{rng.choice(['com', 'org', 'example.com', 'de', 'net'])}"
    if kind == 1:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        body = pick(digits, rng.integers(12, 16))
        body += next(d for d in digits if luhn(body + d))
        return body if rng.random() < 0.6 else " ".join(body[i:i + 4] for i in range(0, len(body), 4))
    if kind == 3:
        return f"+{rng.integers(1, 99)} ({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}" if rng.random() < 0.7 \
            else f"+{rng.integers(1, 99)} {pick(digits, 3)} {pick(digits, 6)}"
    word, code = rng.choice(["password", "token", "key"]), pick(low[:6] + digits, rng.integers(8, 41))
    return f"AKIA{pick(up, 16)}" if rng.random() < 0.3 else f"{word}={code}" if rng.random() < 0.5 else f'{word} = "{code}"'


def train(docs: DataFrame, s: Settings = Settings(), text_col: str = "text") -> Tagger:
    """A tagger from at most s.documents texts (those of smallest hash) and s.windows windows of them. Without any text
    the tagger is untrained and tags nothing."""
    model = Tagger(s)
    sample = (docs.select(F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
              .select("text", F.xxhash64("text").alias("h")))
    cut = sample.select("h").distinct().orderBy("h").limit(s.documents).agg(F.max("h")).collect()[0][0]
    if cut is None:
        return model
    width, each = s.train_window, max(1, s.windows // s.documents)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            texts, labels = [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text) + [(4, *m.span()) for m in _SECRET.finditer(text)]
                rng = np.random.default_rng(len(text))
                starts = rng.integers(0, max(1, len(text) - width), each).tolist()
                starts += [max(0, a - int(rng.integers(0, width // 2))) for _, a, _ in sorted(spans)[:each]]
                for a in starts:
                    gold = bytearray(width)
                    for k, x, y in spans:
                        for i in range(max(x, a), min(y, a + width)):
                            gold[i - a] = k + 1
                    texts.append(text[a:a + width])
                    labels.append(bytes(gold))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(labels, pa.binary())], names=["text", "gold"])

    got = sample.where(F.col("h") <= cut).dropDuplicates(["h"]).select("text").mapInArrow(of, "text string, gold binary").toArrow()
    pairs = sorted(zip(got["text"].to_pylist(), got["gold"].to_pylist(), strict=True))
    rng = np.random.default_rng(1)
    if not pairs:
        return model
    texts, gold = [list(x) for x in zip(*pairs, strict=True)]
    for i in range(len(pairs)):
        text, marks = pairs[i]
        kind = int(rng.integers(0, 5))
        value = _value(kind, rng)
        gaps = [m.start() for m in re.finditer(r"\s", text)] or [0]
        at = int(rng.choice(gaps))
        texts.append((text[:at + 1] + value + " " + text[at + 1:])[:width])
        gold.append((marks[:at + 1] + bytes([kind + 1]) * len(value) + b"\0" + marks[at + 1:])[:width])
    ids, begins = symbols(pa.array(texts, pa.string()))
    table, marks = np.full((len(texts), width), PAD, np.uint8), np.zeros((len(texts), width), np.int64)
    for i in range(len(texts)):
        n = begins[i + 1] - begins[i]
        table[i, :n] = ids[begins[i]:begins[i + 1]]
        marks[i, :n] = np.frombuffer(gold[i][:n], np.uint8)
    model.fit(table, marks)
    return model


def spans(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, kinds, starts, ends (all spans in order of kind and start; code points, end exclusive) and
    base (whether the rules found it). Null and empty texts have none; ids may be null or repeated."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in (part for whole in batches for part in slices(whole, 1, 1 << 20)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, begins = symbols(batch.column(1))
            found: dict[int, list] = {}
            for row, tag, a, b in runs(tagged(own, ids, begins), begins):
                found.setdefault(row, []).append((tag, a, b))
            rows = []
            for i, text in enumerate(texts):
                fixed = base_spans(text)
                more = added(text, fixed, found.get(i, ()), own.s.shortest)
                rows.append(sorted([(k, a, b, True) for k, a, b in fixed] + [(k, a, b, False) for k, a, b in more]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[KINDS[x[0]] for x in r] for r in rows], pa.list_(pa.string())),
                 *(pa.array([[x[j] for x in r] for r in rows], pa.list_(pa.int32())) for j in (1, 2)),
                 pa.array([[x[3] for x in r] for r in rows], pa.list_(pa.bool_()))],
                names=[id_col, "kinds", "starts", "ends", "base"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(
        of, f"`{id_col}` {kind}, kinds array<string>, starts array<int>, ends array<int>, base array<boolean>")


def redacted(docs: DataFrame, model: Tagger, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in square brackets; overlapping spans become one, named
    after the first. All columns stay; a null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text_col)
    schema = docs.schema

    @released
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in (part for whole in batches for part in slices(whole, where, 1 << 20)):
            texts = batch.column(where).to_pylist()
            ids, begins = symbols(batch.column(where))
            found: dict[int, list] = {}
            for row, tag, a, b in runs(tagged(own, ids, begins), begins):
                found.setdefault(row, []).append((tag, a, b))
            out = []
            for i, text in enumerate(texts):
                fixed = base_spans(text or "")
                every = sorted((a, b, k) for k, a, b in fixed + added(text or "", fixed, found.get(i, ()), own.s.shortest))
                if every:
                    parts, end = [], 0
                    for a, b, k in every:
                        if a >= end:
                            parts += [text[end:a], f"[{KINDS[k]}]"]
                        end = max(end, b)
                    text = "".join([*parts, text[end:]])
                out.append(text)
            columns = list(batch.columns)
            columns[where] = pa.array(out, columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(of, schema)
