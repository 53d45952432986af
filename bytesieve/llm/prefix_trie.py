"""Conversations as a trie of turns, by z-fast tries of batches.

A turn's fingerprint depends on its place, role and text; the sum of the first d of them (four 32-bit lanes) names a prefix,
so a node is known by one 128-bit name wherever it occurs. Conversations are cut at every `CUT` turns into strings; a long
one is many strings, each under the node that ends the string before.
Each task inserts its strings, batch by batch, into a z-fast trie: compacted nodes are hashed by the name of their handle,
the prefix whose length is the two-fattest number of the node's edge; a fat binary search over lengths finds the exit node
of a string in a logarithmic number of look-ups, where the string ends on an edge the edge is split, and what is left of it
becomes one new edge. Sums of the members go up the compacted nodes, then edges are expanded and the nodes of all tasks
meet by name in a shuffle that sums them: a prefix that a third of all conversations share is one row per batch there.
Two rounds of this: the first gives every node's smallest member, its owner. The nodes that a conversation owns are the last
ones of its path, so how many of its turns it owns says which of its turns others hold already; with that, children, leaves
and saved tokens are sums over members, and the second round adds them up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytesieve.llm.tables import Scratch, stored, tasks

CUT = 256
BATCH_TURNS = 1 << 18
ORDER_RANGE = 4096
LANES = 4
_ITEM = np.dtype([("name", "V16"), ("before", "<i8")])
_NONE = b"\0" * 16
_FAR = 1 << 62


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, x, y, points) with at: the place from 1 by turn (null first), then x and y. Ranges of `turn` are
    numbered apart and carried by their sizes, so a conversation of any length is many groups."""
    rows = turns.withColumn("range", F.coalesce(F.floor(F.col("turn") / ORDER_RANGE).cast("long"), F.lit(-_FAR)))
    sizes = rows.groupBy("conv", "range").agg(F.count("*").alias("n"))
    carried = sizes.select("conv", "range", (F.sum("n").over(Window.partitionBy("conv").orderBy("range")) - F.col("n")).alias("carried"))
    inside = Window.partitionBy("conv", "range").orderBy("turn", "x", "y")
    return rows.withColumn("inside", F.row_number().over(inside)).join(carried, ["conv", "range"]).select(
        "conv", "x", "y", "points", (F.col("carried") + F.col("inside")).alias("at"))


def borrowed(turns: DataFrame, stored=stored, most: int = 6, group: int = 100) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of c - c % group, then its own after the first h; h is crc32(c) % most.
    Turns are (conv, at, x, y, points) with at from 1; a conversation that keeps none is one row with a null at."""
    own = stored(numbered(turns), "turns")
    sizes = own.groupBy("conv").agg(F.max("at").alias("turns"))
    sizes = sizes.select("conv", "turns", (F.crc32(F.col("conv").cast("string")) % most).alias("h"),
                         (F.col("conv") - F.col("conv") % group).alias("base"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("turns").alias("there"))
    sizes = sizes.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    lent = own.where(F.col("at") < most).select(F.col("conv").alias("base"), "at", "x", "y", "points").join(
        sizes.select("conv", "base", "lent"), "base").where("at <= lent").select("conv", "at", "x", "y", "points")
    kept = own.join(sizes.select("conv", "h", "lent"), "conv").where("at > h").select(
        "conv", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), "x", "y", "points")
    none = sizes.where("lent = 0 and turns <= h").select(
        "conv", *[F.lit(None).cast("long").alias(c) for c in ("at", "x", "y", "points")])
    return lent.unionByName(kept).unionByName(none)


def strings(paths: DataFrame) -> DataFrame:
    """Strings of at most CUT turns: conv, start (turns before), turns (of the whole conversation), total (its code
    points), name (of the prefix before), items (name and code points before of each turn), end (name of the last)."""
    lane = lambda seed, shift: F.expr(
        f"shiftrightunsigned(xxhash64({seed}L, at, x, y), {shift}) & 4294967295L")
    rows = paths.select("conv", "at", F.coalesce(F.expr(f"(at - 1) div {CUT}"), F.lit(0)).cast("long").alias("cut"),
                        *[lane(i // 2, 32 * (i % 2)).alias(f"x{i}") for i in range(LANES)], "points")
    names = [f"x{i}" for i in range(LANES)]
    kept = F.struct("at", *names, "points")
    cut = rows.groupBy("conv", "cut").agg(
        F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), kept))).alias("items"), F.count("at").alias("n"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*names, "points"]])
    before = Window.partitionBy("conv").orderBy("cut")
    whole = Window.partitionBy("conv")
    cut = cut.select("conv", (F.col("cut") * CUT).alias("start"), F.sum("n").over(whole).alias("turns"),
                     F.sum("points").over(whole).alias("total"), "items",
                     *[(F.sum(c).over(before) - F.col(c)).alias(f"before_{c}") for c in [*names, "points"]])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(4)
            flat = items.flatten()
            cuts = np.concatenate([[0], np.cumsum(items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            value = lambda c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
            heads = [batch.column(5 + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(LANES + 1)]
            item, end = np.zeros(len(flat), _ITEM), []
            lanes = [value(f"x{i}") for i in range(LANES)]
            points = value("points")
            for a, b, *head in zip(cuts[:-1].tolist(), cuts[1:].tolist(), *[h.tolist() for h in heads], strict=True):
                sums = np.stack([head[i] + np.cumsum(lanes[i][a:b]) for i in range(LANES)], 1) if b > a else None
                if sums is not None:
                    item["name"][a:b] = np.ascontiguousarray((sums & 0xFFFFFFFF).astype("<u4")).view("V16")[:, 0]
                    item["before"][a:b] = head[LANES] + np.cumsum(points[a:b]) - points[a:b]
                end.append(item["name"][b - 1].tobytes() if b > a else _NONE)
            raw = item.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([raw[24 * a:24 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()),
                 pa.array([np.array(h, "<i8").astype("<u4").tobytes() for h in zip(*[x & 0xFFFFFFFF for x in heads[:LANES]], strict=True)], pa.binary()),
                 pa.array(end, pa.binary())],
                names=["conv", "start", "turns", "total", "items", "name", "end"])

    return cut.mapInArrow(of, "conv long, start long, turns long, total long, items binary, name binary, end binary")


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] with most zeros at its end."""
    return -1 << (low ^ high).bit_length() - 1 & high


class ZFastTrie:
    """Compacted nodes of inserted strings. A node's edge is (low, high] turns of the string `shown`."""

    def __init__(self):
        self.handles: dict[bytes, int] = {}  # name of a handle -> node
        self.edges: dict[bytes, int] = {}  # name of an edge's first prefix -> node
        self.low, self.high, self.shown, self.up = [], [], [], []
        self.start, self.items = [], []

    def name(self, string: int, depth: int) -> bytes:
        at = 24 * (depth - self.start[string] - 1)
        return self.items[string][at:at + 16]

    def _hash(self, node: int) -> None:
        self.handles[self.name(self.shown[node], two_fattest(self.low[node], self.high[node]))] = node

    def _add(self, low: int, high: int, shown: int, up: int) -> int:
        node = len(self.low)
        self.low.append(low), self.high.append(high), self.shown.append(shown), self.up.append(up)
        self.edges[self.name(shown, low + 1)] = node
        self._hash(node)
        return node

    def exit_node(self, string: int, end: int) -> tuple[int, int]:
        """The last node whose handle is a prefix of the string (-1: none), by fat binary search, or its child that the
        string goes on to; and how many turns the string shares with it."""
        low, high, last = self.start[string], end, -1
        while low < high:
            middle = two_fattest(low, high)
            found = self.handles.get(self.name(string, middle), -1)
            if found < 0:
                high = middle - 1
            else:
                last, low = found, self.high[found]
        at = self.start[string] if last < 0 else self.high[last]
        if last < 0 or at <= end and self.name(string, at) == self.name(self.shown[last], at):
            child = self.edges.get(self.name(string, at + 1), -1) if at < end else -1
            if child < 0:
                return last, at
            last = child
        shared, most = self.low[last] + 1, min(end, self.high[last])
        while shared < most:  # prefixes agree up to some length and not beyond
            middle = (shared + most + 1) // 2
            if self.name(string, middle) == self.name(self.shown[last], middle):
                shared = middle
            else:
                most = middle - 1
        return last, shared

    def insert(self, start: int, items: bytes) -> int:
        """Add a string of turns after `start`; the node at which it ends (-1: it has no turns)."""
        string, end = len(self.start), start + len(items) // 24
        self.start.append(start), self.items.append(items)
        node, shared = self.exit_node(string, end)
        if node >= 0 and shared < self.high[node]:
            del self.handles[self.name(self.shown[node], two_fattest(self.low[node], self.high[node]))]
            top = self._add(self.low[node], shared, self.shown[node], self.up[node])
            self.low[node], self.up[node] = shared, top
            self.edges[self.name(self.shown[node], shared + 1)] = node
            self._hash(node)
            node = top
        return self._add(shared, end, string, node) if shared < end else node


FIRST = "depth long, name binary, above binary, conv long, before long, more boolean"
SECOND = "depth long, name binary, conv long, parent long, n long, children long, leaves long, saved long"


def _expanded(trie: ZFastTrie, names: list[bytes]):
    """Every turn of every edge as arrays: node, depth, name, name above, code points before."""
    low, high, shown = (np.array(x, np.int64) for x in (trie.low, trie.high, trie.shown))
    items = np.frombuffer(b"".join(trie.items), _ITEM)
    size = np.array([len(x) // 24 for x in trie.items], np.int64)
    offset = np.cumsum(size) - size - np.array(trie.start, np.int64)
    node = np.repeat(np.arange(len(low)), high - low)
    depth = np.arange(len(node)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[node] + 1
    at = offset[shown[node]] + depth - 1
    name = items["name"][at]
    first = depth - 1 == np.array(trie.start, np.int64)[shown[node]]
    above = items["name"][np.maximum(at - 1, 0)].copy()
    tops = np.frombuffer(b"".join(names), "V16")
    above[first] = tops[shown[node][first]]
    return node, depth, name, above, items["before"][at]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded turns."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False) // 24 + 1)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + BATCH_TURNS, "right")))
            yield batch.slice(at, to - at)
            at = to


def _inserted(batch: pa.RecordBatch):
    trie = ZFastTrie()
    names = batch.column(5).to_pylist()
    ends = [trie.insert(s, i) for s, i in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)]
    return trie, names, np.array(ends, np.int64)


def _upwards(trie: ZFastTrie):
    """Nodes with their parents, the deepest first."""
    return ((i, trie.up[i]) for i in np.argsort(-np.array(trie.high, np.int64), kind="stable").tolist())


def _names(values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def owners_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FIRST: per node of a batch its smallest member and whether any goes on."""
    for batch in _batches(batches):
        trie, names, ends = _inserted(batch)
        conv, start, turns = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        least, more = np.full(len(trie.low), np.iinfo(np.int64).max), np.zeros(len(trie.low), bool)
        on = ends >= 0
        np.minimum.at(least, ends[on], conv[on])
        high = np.array(trie.high, np.int64)
        np.logical_or.at(more, ends[on], turns[on] > high[ends[on]])
        for i, up in _upwards(trie):
            if up >= 0:
                least[up], more[up] = min(least[up], least[i]), True
        node, depth, name, above, before = _expanded(trie, names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth, pa.int64()), _names(name), _names(above), pa.array(least[node]), pa.array(before, pa.int64()),
             pa.array((depth < high[node]) | more[node])], names=["depth", "name", "above", "conv", "before", "more"])
        root = start == 0
        if root.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int64()), pa.array([_NONE]), pa.array([_NONE]), pa.array([int(conv[root].min())], pa.int64()),
                 pa.array([0], pa.int64()), pa.array([bool((turns[root] > 0).any())])],
                names=["depth", "name", "above", "conv", "before", "more"])


def sums_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SECOND: per node of a batch the sums over its members. Columns after the string's: owned (depth from which the
    conversation owns its path), held (code points before that), leaf, parent (owner of the node it branches off)."""
    for batch in _batches(batches):
        trie, names, ends = _inserted(batch)
        conv, start, turns, _, owned, held, leaf = (
            batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2, 3, 7, 8, 9))
        parent = batch.column(10).to_pylist()
        size = len(trie.low)
        low, high = np.array(trie.low, np.int64), np.array(trie.high, np.int64)
        first = np.full(size, -1, np.int64)  # the row of the smallest member
        n, sum_held, leaves, forks = (np.zeros(size, np.int64) for _ in range(4))
        on = np.flatnonzero(ends >= 0)
        order = on[np.argsort(-conv[on], kind="stable")]
        first[ends[order]] = order
        np.add.at(n, ends[on], 1)
        np.add.at(sum_held, ends[on], held[on])
        np.add.at(leaves, ends[on], leaf[on])
        # members that own the node after a node's last turn, ends at a cut included
        goes_on = on[(turns[on] > high[ends[on]]) & (owned[on] <= high[ends[on]] + 1)]
        np.add.at(forks, ends[goes_on], 1)
        root_forks = 0
        for i, up in _upwards(trie):
            opens = int(owned[first[i]] <= low[i] + 1)
            if up >= 0:
                n[up] += n[i]
                sum_held[up] += sum_held[i]
                leaves[up] += leaves[i]
                forks[up] += opens
                if first[up] < 0 or conv[first[i]] < conv[first[up]]:
                    first[up] = first[i]
            elif low[i] == 0:
                root_forks += opens
        node, depth, name, _, before = _expanded(trie, names)
        who = first[node]
        mine = owned[who] <= depth
        saved = sum_held[node] - n[node] * before - np.where(mine, held[who] - before, 0)
        inner = depth < high[node]
        children = np.where(inner, owned[who] <= depth + 1, forks[node])
        from_there = np.array([-1 if p is None else p for p in parent], np.int64)
        is_null = np.array([p is None for p in parent], bool)
        over = np.where(owned[who] < depth, conv[who], from_there[who])
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth, pa.int64()), _names(name), pa.array(conv[who]), pa.array(over, mask=~mine | (owned[who] == depth) & is_null[who]),
             pa.array(n[node]), pa.array(children.astype(np.int64)), pa.array(leaves[node]), pa.array(saved)],
            names=["depth", "name", "conv", "parent", "n", "children", "leaves", "saved"])
        root = np.flatnonzero(start == 0)
        if len(root):
            top = root[np.argmin(conv[root])]
            total = int(held[root].sum()) - (int(held[top]) if owned[top] == 0 else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int64()), pa.array([_NONE]), pa.array([int(conv[top])], pa.int64()), pa.array([None], pa.int64()),
                 pa.array([len(root)], pa.int64()), pa.array([root_forks], pa.int64()), pa.array([int(leaf[root].sum())], pa.int64()),
                 pa.array([total], pa.int64())],
                names=["depth", "name", "conv", "parent", "n", "children", "leaves", "saved"])


def ends_digests(made: DataFrame) -> DataFrame:
    """(depth, name, digest): SHA-256 of the ids that end at a node, ascending and comma-joined. Ranges of ids are joined
    apart; one task per node feeds the joined pieces to the digest in turn and holds one piece at a time."""
    last = made.where(f"turns - start <= {CUT}").select(F.col("turns").alias("depth"), F.col("end").alias("name"), "conv")
    pieces = last.groupBy("depth", "name", F.floor(F.col("conv") / ORDER_RANGE).alias("range")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for depth, name, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "name", "ids")], strict=True):
                if (depth, name) != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (depth, name), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield _digest_rows(done)
        if key is not None:
            yield _digest_rows([(*key, digest.hexdigest())])

    return pieces.repartition(tasks(made.sparkSession), "depth", "name").sortWithinPartitions("depth", "name", "range").mapInArrow(
        of, "depth long, name binary, digest string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    depth, name, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(name, pa.binary()), pa.array(digest)],
                                      names=["depth", "name", "digest"])


def owned_parts(nodes: DataFrame) -> DataFrame:
    """Per owner: owned (depth of its first own node), held (code points before it), leaf (1 if its last node has no
    child) and parent (owner of the node it branches off)."""
    first = F.min(F.struct("depth", "above", "before")).alias("first")
    last = F.max(F.struct("depth", F.col("more").cast("int").alias("more"))).alias("last")
    per = nodes.groupBy("conv").agg(first, last).select(
        "conv", F.col("first.depth").alias("owned"), F.col("first.before").alias("held"),
        (1 - F.col("last.more")).alias("leaf"), (F.col("first.depth") - 1).alias("depth"), F.col("first.above").alias("name"))
    above = nodes.select("depth", "name", F.col("conv").alias("parent"))
    return per.join(above, ["depth", "name"], "left").select("conv", "owned", "held", "leaf", "parent")


def prefix_nodes(paths: DataFrame) -> DataFrame:
    """depth, name, conv, parent, n, children, leaves, saved, ends_sha256 of every node of the paths (conv, at from 1
    without gaps, x and y: digest of the turn, points: code points of its text; a null at: no turn). No paths: no rows."""
    with Scratch(paths.sparkSession) as scratch:
        made = scratch.stored(strings(paths), "strings")
        nodes = scratch.stored(made.mapInArrow(owners_of_batches, FIRST).groupBy("depth", "name").agg(
            F.min("above").alias("above"), F.min("conv").alias("conv"), F.min("before").alias("before"),
            F.max("more").alias("more")), "nodes")
        owned = scratch.stored(owned_parts(nodes), "owned")
        rows = made.join(owned, "conv", "left").select(
            *made.columns, F.coalesce("owned", F.col("turns") + 1).alias("owned"), F.coalesce("held", "total").alias("held"),
            F.coalesce("leaf", F.lit(0)).alias("leaf"), "parent")
        sums = rows.mapInArrow(sums_of_batches, SECOND).unionByName(ends_digests(made), allowMissingColumns=True)
        done = sums.groupBy("depth", "name").agg(
            F.min("conv").alias("conv"), F.max("parent").alias("parent"), F.sum("n").alias("n"), F.sum("children").alias("children"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
            F.coalesce(F.max("digest"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
        return stored(done, "trie")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn (null first), ties by the turn's digest; null role or text counts as empty; equal turns of one place
    are turns of their own. Rows without conv_id are left out. A conversation left without turns belongs to the root alone.
    Texts of any length are digested where they are read and never shuffled. An empty table gives no rows; other columns are
    not looked at."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("x"), F.xxhash64(F.lit(2), role, text).alias("y"),
        F.length(text).cast("long").alias("points"))
    with Scratch(conversations.sparkSession) as scratch:
        made = prefix_nodes(borrowed(turns, scratch.stored))
    return made.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        "ends_sha256")
