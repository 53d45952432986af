"""Many byte patterns searched in one pass: an Aho-Corasick automaton over Arrow batches.

Bytes are read as Latin-1 text, one character a byte. The cost of a pass follows the bytes and the matches, not the number
of patterns."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from bytesieve import rules

SCAN = "struct<hits:array<struct<rule:string,at:bigint>>,blocked_by:string,filtered:binary>"


class Scanner:
    """Rules in order. Patterns may repeat, overlap or contain one another; an empty one never matches."""

    def __init__(self, rule_set: Sequence[rules.FilterRule]):
        import ahocorasick
        self.rules = list(rule_set)
        by_pattern: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            if r.pattern:
                by_pattern.setdefault(r.pattern.decode("latin-1"), []).append(i)
        self.texts = [r.pattern.decode("latin-1") for r in self.rules]
        self.automaton = ahocorasick.Automaton()
        for text, held in by_pattern.items():
            self.automaton.add_word(text, (len(text), held))
        if by_pattern:
            self.automaton.make_automaton()
        self.any = bool(by_pattern)

    def first(self, text: str) -> dict[int, int]:
        """Rules that match, with the position of their first match."""
        found: dict[int, int] = {}
        if self.any:
            for end, (size, held) in self.automaton.iter(text):
                if held[0] not in found:
                    for i in held:
                        found[i] = end - size + 1
        return found

    def spans(self, text: str):
        """(start, end) of every match."""
        return ((end - size + 1, end + 1) for end, (size, _) in self.automaton.iter(text)) if self.any else iter(())

    def run(self, text: str, found: dict[int, int]) -> tuple[str | None, str | None]:
        """Rules in order on what earlier removals left: the name of the first that blocks, and the reduced text (None
        if nothing went). Only a removal that matches calls for another pass."""
        at, cur = 0, text
        while True:
            acting = [i for i in found if i >= at and self.rules[i].action in ("BlockSegment", "RemoveBytes")]
            if not acting:
                return None, cur if cur is not text else None
            i = min(acting)
            if self.rules[i].action == "BlockSegment":
                return self.rules[i].name, cur if cur is not text else None
            at, cur = i + 1, cur.replace(self.texts[i], "")
            found = self.first(cur)


def scanned(data: Column, rule_set: Sequence[rules.FilterRule]) -> Column:
    """STRUCT of hits (rule and first position in the raw bytes, in rule order), blocked_by, and filtered (NULL where
    no byte was removed). NULL bytes have no hits."""
    fixed = tuple(rule_set)

    @F.arrow_udf(SCAN)
    def run(values: pa.Array) -> pa.Array:
        scanner = _scanner(fixed)
        hits, blocked, filtered = [], [], []
        for value in values.to_pylist():
            text = (value or b"").decode("latin-1")
            found = scanner.first(text)
            by, left = scanner.run(text, found) if found else (None, None)
            hits.append([{"rule": scanner.rules[i].name, "at": found[i]} for i in sorted(found)])
            blocked.append(by)
            filtered.append(None if left is None else left.encode("latin-1"))
        kind = pa.list_(pa.struct([("rule", pa.string()), ("at", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(hits, kind), pa.array(blocked, pa.string()), pa.array(filtered, pa.binary())],
                                          names=["hits", "blocked_by", "filtered"])

    return run(data)


CLEANED = "struct<blocked_by:string,clean:binary>"
SLICE_BYTES = 8 << 20


def _repaired(raw: bytes, scanner: Scanner, text: str | None) -> bytes | None:
    """Whole transport packets with the bad ones replaced (None if there are none); rules are searched in payloads if the
    text is given."""
    size = rules.TS_PACKET_SIZE
    packets = np.frombuffer(raw, np.uint8).reshape(-1, size)
    bad = _bad_headers(packets[:, 0], packets[:, 1], packets[:, 2])
    if text is not None:
        for start, end in scanner.spans(text):
            if start % size >= 4 and end <= start - start % size + size:
                bad[start // size] = True
    if not bad.any():
        return None
    packets = packets.copy()
    packets[bad] = np.frombuffer(rules.TS_NULL_PACKET, np.uint8)
    return packets.tobytes()


def _bad_headers(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Packets out of sync or of a reserved PID: its high five bits are in byte 1, its low eight in byte 2."""
    low, high = rules.TS_RESERVED_PIDS
    return (first != rules.TS_SYNC_BYTE) | (second & 31 == 0) & (third >= low) & (third <= high)


def _is_transport(raw: bytes) -> bool:
    return len(raw) >= rules.TS_PACKET_SIZE and len(raw) % rules.TS_PACKET_SIZE == 0 and raw[0] == rules.TS_SYNC_BYTE


def _clean_slice(values: pa.LargeBinaryArray, scanner: Scanner, repair: bool) -> tuple[list[str | None], list[bytes | None]]:
    n, size = len(values), rules.TS_PACKET_SIZE
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + n + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    blocked: list[str | None] = [None] * n
    clean: list[bytes | None] = [None] * n
    # one pass over the bytes of all rows; a match across two rows is none
    text, bounds = data.tobytes().decode("latin-1"), offsets.tolist()
    found: dict[int, dict[int, int]] = {}
    for end, (length, held) in scanner.automaton.iter(text):
        row = bisect_right(bounds, end) - 1
        if end - length + 1 >= bounds[row]:
            own = found.setdefault(row, {})
            for i in held:
                own.setdefault(i, 0)
    for row, own in found.items():
        was = text[bounds[row]:bounds[row + 1]]
        blocked[row], left = scanner.run(was, own)
        now = (was if left is None else left).encode("latin-1")
        if repair and blocked[row] is None and _is_transport(now):
            fixed = _repaired(now, scanner, was if left is None else left)
            clean[row] = fixed if fixed is not None else None if left is None else now
        elif left is not None:
            clean[row] = now
    if not repair:
        return blocked, clean
    # packets of the other rows at once
    lengths = np.diff(offsets)
    rows = np.flatnonzero((lengths >= size) & (lengths % size == 0))
    rows = rows[(data[offsets[rows]] == rules.TS_SYNC_BYTE) & ~np.isin(rows, np.fromiter(found, np.int64, len(found)))]
    count = lengths[rows] // size
    at = np.repeat(offsets[rows], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * size
    bad = _bad_headers(data[at], data[at + 1], data[at + 2])
    for row in np.unique(np.repeat(rows, count)[bad]).tolist():
        clean[row] = _repaired(data[bounds[row]:bounds[row + 1]].tobytes(), scanner, None)
    return blocked, clean


def cleaned(data: Column, rule_set: Sequence[rules.FilterRule], repair: bool = True) -> Column:
    """STRUCT of blocked_by and clean, the bytes after removals and, where they are transport packets that no rule blocks,
    repair (NULL where no byte changed): one pass over the bytes decides block, removal and suspect packets. Without
    ``repair`` bytes are never read as packets."""
    fixed = tuple(rule_set)

    @F.arrow_udf(CLEANED)
    def run(values: pa.Array) -> pa.Array:
        scanner = _scanner(fixed)
        values = values.cast(pa.large_binary()).fill_null(b"")
        ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False))
        blocked, clean, at = [], [], 0
        while at < len(values):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            for out, part in zip((blocked, clean), _clean_slice(values.slice(at, to - at), scanner, repair), strict=True):
                out += part
            at = to
        return pa.StructArray.from_arrays([pa.array(blocked, pa.string()), pa.array(clean, pa.binary())], names=["blocked_by", "clean"])

    return run(data)


_made: dict[tuple, Scanner] = {}


def _scanner(rule_set: tuple[rules.FilterRule, ...]) -> Scanner:
    """One automaton per worker and rule set."""
    if rule_set not in _made:
        _made.clear()
        _made[rule_set] = Scanner(rule_set)
    return _made[rule_set]
