"""Byte-level BPE by backtracking over longest matches.

Token bytes are read as Latin-1 text, so an Aho-Corasick automaton over the vocabulary gives all tokens that begin at
each place of a piece. Encoding takes the longest, and keeps it if it may stand beside the token before: two tokens are
compatible if the merges by rank, run over the bytes of both, give just these two. Otherwise a shorter token is tried,
and when none is left one token is taken back. The bytes up to a place have one encoding only, so a place from which
nothing led on is never tried again and the time is linear in the piece. A sequence whose neighbours are all compatible
is what the merges give for the whole piece."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve.llm.memory import released
from bytesieve.llm.words import slices

KEPT_PIECES, KEPT_PAIRS, LONG_TEXT = 150_000, 500_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of base64 tokens and ranks, one per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Ids of pieces by ranks. Every single byte must be a token. What is remembered of pieces and pairs is bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.text = {v: k for k, v in self.ranks.items()}
        self.digits = {v: str(v) for v in self.text}
        if any(chr(b) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.matches = ahocorasick.Automaton()
        for k, v in self.ranks.items():
            self.matches.add_word(k, (v, len(k)))
        self.matches.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple[list[int], list[int]] | None] = {}
        self.pieces: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def merged(self, text: str) -> list[int]:
        """The merges themselves, step by step; for short texts."""
        parts, none = list(text), 1 << 60
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if rank == none:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def spines(self, token: int):
        """The tokens a token is made of along its left and its right edge, single byte first, the token last; None if
        the merges do not make it from parts of lower rank."""
        known = self.edges.get(token, False)
        if known is not False:
            return known
        text = self.text[token]
        made = ([token], [token]) if len(text) == 1 else None
        if made is None:
            parts, none, last = list(text), 1 << 60, -1
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
                if rank == none:
                    break
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                left, right = (self.ranks[p] for p in parts)
                lower = all(len(p) == 1 or self.ranks[p] < token for p in parts)
                a, b = self.spines(left), self.spines(right)
                if lower and a and b:
                    made = (a[0] + [token], b[1] + [token])
        self.edges[token] = made
        return made

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens may be neighbours; left -1 stands for the start of a piece."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        a, b = self.spines(right) if left < 0 else self.spines(left), self.spines(right)
        if left < 0 and b:
            return True
        if not a or not b:
            text = self.text[right]
            return self.merged(text) == [right] if left < 0 else self.merged(self.text[left] + text) == [left, right]
        # both edges grow in order of rank; a merge across the border must never be the next one
        a, b, i, j, none = a[1], b[0], 0, 0, 1 << 60
        while True:
            across = self.ranks.get(self.text[a[i]] + self.text[b[j]], none)
            up_a = a[i + 1] if i + 1 < len(a) else none
            up_b = b[j + 1] if j + 1 < len(b) else none
            if across < up_a and across <= up_b:
                return False
            if up_a == up_b == none:
                return True
            if up_a <= up_b:
                i += 1
            else:
                j += 1

    def encode_bytes(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        ids = [token for _, (token, _) in self.matches.iter_long(text)]
        left = -1
        for token in ids:
            if not self.compatible(left, token):
                break
            left = token
        else:
            return ids
        at: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, (token, size) in self.matches.iter(text):
            at[end - size + 1].append((token, size))
        ids, turn, dead, pos, n = [], [], bytearray(len(text) + 1), 0, len(text)
        k = len(at[0]) if n else 0
        while pos < n:
            left = ids[-1] if ids else -1
            while k:
                k -= 1
                token, size = at[pos][k]
                if not dead[pos + size] and self.compatible(left, token):
                    ids.append(token)
                    turn.append(k)
                    pos += size
                    k = len(at[pos]) if pos < n else 0
                    break
            else:
                dead[pos] = 1
                if not ids:
                    return self.merged(text)  # a vocabulary whose tokens the merges cannot all reach
                pos -= len(self.text[ids.pop()])
                k = turn.pop()
        return ids

    def decode(self, ids) -> bytes:
        return "".join(map(self.text.__getitem__, ids)).encode("latin-1")

    def known(self, piece: str) -> tuple[str, bytes]:
        """Comma-joined ids, and the bytes they decode to. The pieces met last are remembered, up to twice
        KEPT_PIECES."""
        made = self.older.get(piece)
        if made is None:
            ids = self.encode_bytes(piece.encode("utf-8", "surrogatepass"))
            made = (",".join([self.digits[i] for i in ids]), self.decode(ids))
        if len(piece) <= 64:
            self.pieces[piece] = made
        return made

    def forget(self) -> None:
        """Drops what is remembered of pieces; workers outlive their tasks, and the next may do other work."""
        self.pieces, self.older = {}, {}

    def pieces_of(self, text: str, pattern) -> Iterator[list[tuple[str, bytes]]]:
        """What is known of all pieces of a text, in runs, so that a very long text is never held as pieces."""
        if len(text) <= LONG_TEXT:
            runs = iter([pattern.findall(text)])
        else:
            found = (m[0] for m in pattern.finditer(text))
            runs = iter(lambda: list(islice(found, 50_000)), [])
        for run in runs:
            if len(self.pieces) >= KEPT_PIECES:
                self.older, self.pieces = self.pieces, {}
            get, known = self.pieces.get, self.known
            yield [get(p) or known(p) for p in run]


# The usual pattern, and its meaning for texts of characters below U+0250 without fractions, superscripts
# and control characters, where two engines agree.
_USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTERS, _BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "\\x09-\\x0d \x85\xa0"
_OTHER = re.compile("[\x00-\x08\x0e-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
_PLAIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_BLANKS}{_LETTERS}0-9]+"
                    f"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")


class Splitter:
    """A pattern's matches; most texts in the usual pattern go through an equal one that is faster."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        self.usual = pattern == _USUAL

    def _for(self, text: str):
        return _PLAIN if self.usual and not _OTHER.search(text) else self.full

    def findall(self, text: str) -> list[str]:
        return self._for(text).findall(text)

    def finditer(self, text: str):
        return self._for(text).finditer(text)


_encoders: dict[str, Encoder] = {}


def encoder(shared) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(shared.ranks)
    return _encoders[shared.id]


class Vocabulary:
    """Ranks sent to the workers once; a vocabulary is a fixed file of at most some megabytes."""

    def __init__(self, spark, path: str):
        self.sent = spark.sparkContext.broadcast(read_ranks(path))
        self.id = path

    @property
    def ranks(self) -> dict[bytes, int]:
        return self.sent.value


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
            with_ids: bool = True) -> DataFrame:
    """Per row of docs: id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the bytes that
    the ids decode to), and with_ids the ids themselves. Each match of the pattern is encoded by itself; no special
    tokens. A null or empty text has no tokens. Ids of rows may be null or repeated."""
    vocabulary = Vocabulary(docs.sparkSession, path)

    @released
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = encoder(vocabulary), Splitter(pattern)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            counts, ids_sha, decoded_sha, ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                n, a, b, written = 0, hashlib.sha256(), hashlib.sha256(), []
                for run in own.pieces_of(text or "", split):
                    if run:
                        part = ",".join([p[0] for p in run])
                        a.update((("," if n else "") + part).encode())
                        b.update(b"".join([p[1] for p in run]))
                        n += part.count(",") + 1
                        if with_ids:
                            written += map(int, part.split(","))
                counts.append(n)
                ids_sha.append(a.hexdigest())
                decoded_sha.append(b.hexdigest())
                ids.append(written)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                       pa.array(decoded_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        own.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(
        of, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
        + (", ids array<int>" if with_ids else ""))
