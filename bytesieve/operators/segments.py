"""Media segments: rule filtering, transport repair, ordering, accounting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bytesieve import rules
from bytesieve.functions import bytesx as B
from bytesieve.functions import ordered as O
from bytesieve.functions.automaton import cleaned, scanned
from bytesieve.operators import dims

Rule = rules.FilterRule
DEFAULT = rules.FILTER_RULES
WORD_RULES = 62  # rules per 64-bit mask


# ------------------------------------------------------------ stream kinds

def stream_type(url: Column) -> Column:
    u = F.lower(url)
    ends = F.lit(False)
    for suffix in rules.PROGRESSIVE_SUFFIXES:
        ends = ends | F.endswith(u, F.lit(suffix))
    return (
        F.when(F.endswith(u, F.lit(".m3u8")) | F.contains(u, F.lit("/hls/")), "Hls")
        .when(F.endswith(u, F.lit(".mpd")) | F.contains(u, F.lit("/dash/")), "Dash")
        .when(F.startswith(u, F.lit("rtmp://")), "Rtmp")
        .when(F.startswith(u, F.lit("rtsp://")), "Rtsp")
        .when(ends, "Progressive").otherwise("Unknown")
    )


def with_protocol(df: DataFrame) -> DataFrame:
    """Add display name and streaming flag of ``stream_type``."""
    return df.join(F.broadcast(dims.stream_types(df.sparkSession)), "stream_type", "left")


def track_decisions(tracks: DataFrame, kind: str = "track_kind") -> DataFrame:
    """KEEP or DROP per container track; kinds without a policy are dropped."""
    policy = dims.track_policy(tracks.sparkSession).withColumnRenamed("track_kind", kind)
    return tracks.join(F.broadcast(policy), kind, "left").withColumn(
        "decision", F.coalesce("decision", F.lit("DROP")))


# ------------------------------------------------------------ rules

def rules_from(df: DataFrame, most: int = 100_000, most_bytes: int = 1 << 24) -> list[Rule]:
    """User rules from a (ord, name, pattern, severity, action) table, in ``ord`` order.  Every task needs them all, so
    a table beyond ``most`` rows or ``most_bytes`` of patterns is refused before it is fetched."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    if n > most or size > most_bytes:
        raise ValueError(f"{n} rules with {size} bytes of patterns are more than {most} or {most_bytes}")
    return [Rule(r["name"], bytes(r["pattern"]), r["severity"], r["action"])
            for r in df.where(F.col("pattern").isNotNull()).orderBy("ord").collect()]


def scan_rules(df: DataFrame, rule_set: list[Rule], data: str = "data") -> DataFrame:
    """Any number of rules in one pass over the bytes: add ``rule_hits`` (rule and first position, in rule order),
    ``blocked_by`` and ``filtered``, as the rule-by-rule forms below define them."""
    made = df.withColumn("_scan", scanned(F.col(data), rule_set))
    return made.select(*df.columns, F.coalesce("_scan.hits", F.array().cast("array<struct<rule:string,at:bigint>>")).alias("rule_hits"),
                       F.col("_scan.blocked_by").alias("blocked_by"), F.coalesce("_scan.filtered", data).alias("filtered"))


def _active(rule_set: list[Rule]) -> list[Rule]:
    return [r for r in rule_set if r.pattern]  # an empty pattern never matches


def _masks(data: Column, active: list[Rule]) -> dict[str, Column]:
    """Rules present in the bytes, one bit each, in as many words as the rules need."""
    out = {}
    for low in range(0, max(1, len(active)), WORD_RULES):
        word = F.lit(0).cast("long")
        for i, r in enumerate(active[low:low + WORD_RULES]):
            word = word.bitwiseOR(F.when(B.has(data, r.pattern), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        out[f"_mask{low // WORD_RULES}"] = word
    return out


def with_rule_hits(df: DataFrame, rule_set: list[Rule] = DEFAULT, data: str = "data") -> DataFrame:
    active = _active(rule_set)
    masks = _masks(F.col(data), active)
    hits = [F.when(F.getbit(f"_mask{i // WORD_RULES}", F.lit(i % WORD_RULES)) == 1, F.lit(r.name)) for i, r in enumerate(active)]
    named = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return df.withColumns(masks).withColumn("rule_hits", named).drop(*masks)


def rule_hit_counts(df: DataFrame, rule_set: list[Rule] = DEFAULT, data: str = "data") -> DataFrame:
    """Segments per triggered rule: counted as bit sums in one scan."""
    active = _active(rule_set)
    one = df.select(*[m.alias(n) for n, m in _masks(F.col(data), active).items()]).agg(*[
        F.sum(F.getbit(f"_mask{i // WORD_RULES}", F.lit(i % WORD_RULES)).cast("long")).alias(f"r{i}") for i in range(len(active))])
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
                              F.col(f"r{i}").alias("segments")) for i, r in enumerate(active)])
    return one.select(F.inline(rows)).where("segments > 0")


def with_filtered(df: DataFrame, rule_set: list[Rule] = DEFAULT, data: str = "data") -> DataFrame:
    """Run the rules in order; add ``blocked_by`` and the reduced ``filtered`` bytes.

    The first blocking rule stops the run and leaves the bytes as reduced so
    far.  Segments without any removable pattern keep their bytes untouched:
    no decode, no copy.
    """
    raw = F.col(data)
    active = _active(rule_set)
    removable = F.lit(False)
    for r in active:
        if r.action == "RemoveBytes":
            removable = removable | B.has(raw, r.pattern)
    staged = df.withColumn("_touched", removable)
    blocked, texts, cur, touched = [], [], None, False
    for r in active:
        if r.action == "BlockSegment":
            hit = B.has(raw, r.pattern)
            if touched:
                hit = F.when(F.col("_touched"), F.contains(cur, B.latin1_lit(r.pattern))).otherwise(hit)
            blocked.append((hit, r.name))
            texts.append((r.name, cur if touched else None))
        elif r.action == "RemoveBytes":
            cur = B.remove_all(B.latin1(raw) if cur is None else cur, r.pattern)
            touched = True
    by = F.lit(None).cast("string")
    for hit, name in reversed(blocked):
        by = F.when(hit, F.lit(name)).otherwise(by)
    staged = staged.withColumn("blocked_by", by)
    out = B.from_latin1(cur) if touched else raw
    for name, text in texts:
        at_block = raw if text is None else B.from_latin1(text)
        if touched:
            out = F.when(F.col("blocked_by") == name, at_block).otherwise(out)
    if touched:
        out = F.when(F.col("_touched"), out).otherwise(raw)
    return staged.withColumn("filtered", out).drop("_touched")


def filter_chunks(df: DataFrame, rule_set: list[Rule] = DEFAULT, data: str = "data") -> DataFrame:
    """Chunk mode: a blocked chunk becomes empty; only this chunk is searched."""
    out = with_filtered(df, rule_set, data)
    return out.withColumn("filtered", F.when(
        F.col("blocked_by").isNotNull(), F.lit(bytearray())).otherwise(F.col("filtered")))


def filter_segments(df: DataFrame, rule_set: list[Rule] = DEFAULT, data: str = "data",
                    max_size: int = rules.MAX_SEGMENT_SIZE, repair: bool = True) -> DataFrame:
    """Segment mode: add ``is_clean``, ``issues`` and ``clean_data``.

    Oversize and blocked segments keep their bytes and turn dirty; the others
    are transport-repaired where they look like transport packets.  All of it takes one pass over the bytes.
    ``repair=False`` is for segments known to hold no packets: a text may begin with the sync byte, a G, and be 188 bytes long.
    """
    size, raw = F.octet_length(F.col(data)), F.col(data)
    active = _active(rule_set)
    by, clean = F.lit(None).cast("string"), raw
    staged = df.withColumn("_big", size > max_size)
    if active:
        staged = staged.withColumn("_made", cleaned(raw, active, repair))
        by, clean = F.col("_made.blocked_by"), F.coalesce("_made.clean", raw)
    return staged.select(
        *df.columns,
        (~F.col("_big") & by.isNull()).alias("is_clean"),
        F.when(F.col("_big"), F.array(F.format_string("Segment too large: %d bytes", size)))
        .when(by.isNotNull(), F.array(F.concat(F.lit("Blocked by rule: "), by)))
        .otherwise(F.array().cast("array<string>")).alias("issues"),
        F.when(F.col("_big"), raw).otherwise(clean).alias("clean_data"),
    )


def oversize(data: Column, limit: int = rules.MAX_SEGMENT_SIZE) -> Column:
    return F.octet_length(data) > limit


# ------------------------------------------------------------ transport packets

def is_ts(data: Column) -> Column:
    n = F.octet_length(data)
    return (n >= rules.TS_PACKET_SIZE) & (n % rules.TS_PACKET_SIZE == 0) & F.startswith(
        data, B.blob(bytes([rules.TS_SYNC_BYTE])))


def _packet(data: Column, i: Column) -> Column:
    return F.substring(data, (i * rules.TS_PACKET_SIZE + 1).cast("int"), F.lit(rules.TS_PACKET_SIZE))


def packet_pid(pkt: Column) -> Column:
    return F.conv(F.hex(F.substring(pkt, 2, 2)), 16, 10).cast("int").bitwiseAND(F.lit(rules.TS_NULL_PID))


def _numbers(data: Column) -> Column:
    n = F.floor(F.octet_length(data) / rules.TS_PACKET_SIZE).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def ts_packets(df: DataFrame, data: str = "data") -> DataFrame:
    """One row per whole packet: number, bytes, sync flag and PID."""
    keep = [c for c in df.columns if c != data]
    # Packets are cut before they are exploded, so no row carries the whole segment.
    packets = F.transform(_numbers(F.col(data)), lambda i: _packet(F.col(data), i))
    cut = df.select(*keep, F.posexplode(packets).alias("pkt_no", "pkt"))
    return cut.select(
        *keep, "pkt_no", "pkt", F.startswith("pkt", B.blob(bytes([rules.TS_SYNC_BYTE]))).alias("is_valid"),
        packet_pid(F.col("pkt")).alias("pid"))


def pid_flags(pid: Column) -> dict[str, Column]:
    low, high = rules.TS_RESERVED_PIDS
    reserved = pid.between(low, high)
    return {"is_null": pid == rules.TS_NULL_PID, "is_reserved": reserved,
            "has_valid_pid": (pid <= 8191) & ~reserved}


def pid_census(packets: DataFrame, key: str = "stream_id") -> DataFrame:
    """Packets per PID and stream, invalid and reserved ones apart."""
    flags = pid_flags(F.col("pid"))
    return packets.groupBy(key, "pid").agg(
        F.count("*").alias("packets"), F.count(F.when(~F.col("is_valid"), 1)).alias("bad_sync"),
        F.count(F.when(flags["is_reserved"], 1)).alias("reserved"))


def ts_repaired(data: Column, rule_set: list[Rule] = DEFAULT) -> Column:
    """Replace bad packets by null packets, in place and in order.

    Works inside the row, so packets are never shuffled apart and joined again.
    Payloads are searched packet by packet only in segments where some rule
    matches anywhere at all; that first test is one pass in generated code.
    """
    active = _active(rule_set)
    null_packet = B.latin1_lit(rules.TS_NULL_PACKET)
    low, high = rules.TS_RESERVED_PIDS
    suspect = F.lit(False)
    for r in active:
        suspect = suspect | B.has(data, r.pattern)

    def fixed(search: bool) -> Column:
        def fix(t: Column) -> Column:
            # The PID's high five bits are in byte 1, its low eight in byte 2.
            reserved = (F.ascii(F.substring(t, 2, 1)) % 32 == 0) & F.ascii(F.substring(t, 3, 1)).between(low, high)
            bad = ~F.startswith(t, F.lit(chr(rules.TS_SYNC_BYTE))) | reserved
            if search:
                payload = F.substring(t, 5, rules.TS_PACKET_SIZE - 4)
                for r in active:
                    bad = bad | F.contains(payload, B.latin1_lit(r.pattern))
            return F.when(bad, null_packet).otherwise(t)
        packets = F.transform(_numbers(data), lambda i: B.latin1(_packet(data, i)))
        return F.array_join(F.transform(packets, fix), "")

    whole = F.when(suspect, fixed(True)).otherwise(fixed(False))
    used = F.floor(F.octet_length(data) / rules.TS_PACKET_SIZE) * rules.TS_PACKET_SIZE
    rest = F.substring(data, (used + 1).cast("int"), F.lit(rules.TS_PACKET_SIZE))
    return F.concat(B.from_latin1(whole), rest)


# ------------------------------------------------------------ order

lookup = O.lookup


def arrivals(df: DataFrame, key: str = "stream_id", idx: str = "idx", order: list[str] = ()) -> DataFrame:
    """One row per (stream, index): the first by ``order``, by content where that ties or is not given; a repeated
    segment is ignored."""
    rest = [c for c in df.columns if c not in (key, idx)]
    by = F.struct(*[F.col(c) for c in (*order, *rest)])
    return df.groupBy(key, idx).agg(F.min_by(F.struct(*rest), by).alias("_v")).select(key, idx, "_v.*").select(df.columns)


def first_gaps(df: DataFrame, key: str = "stream_id", idx: str = "idx") -> DataFrame:
    """Per stream, the first index not present (0 when index 0 is missing).

    Every index i offers i+1 as a candidate; the smallest candidate without a
    row is the gap.  Grouped by (stream, index), so long streams spread out.
    """
    marks = df.select(key, F.inline(F.array(
        F.struct(F.col(idx).cast("long").alias("_i"), F.lit(True).alias("_here")),
        F.struct((F.col(idx) + 1).cast("long").alias("_i"), F.lit(False).alias("_here")),
        F.struct(F.lit(0).cast("long").alias("_i"), F.lit(False).alias("_here")))))
    seen = marks.groupBy(key, "_i").agg(F.bool_or("_here").alias("_here"))
    return seen.where("not _here and _i >= 0").groupBy(key).agg(F.min("_i").alias("next_idx"))


def reassemble(df: DataFrame, key: str = "stream_id", idx: str = "idx",
               max_waiting: int = rules.MAX_BUFFERED_SEGMENTS) -> DataFrame:
    """Status per segment: written (before the first gap) or waiting.  Give it narrow rows: no bytes are needed."""
    out = lookup(df, first_gaps(df, key, idx), [key], [idx])
    return out.withColumn("state", F.when(F.col(idx) < F.col("next_idx"), "written").otherwise("waiting"))


def _when(idx: str, arrival: str) -> Column:
    """The order of arrivals: equal ones go by index."""
    return F.struct(F.col(arrival).cast("long").alias("at"), F.col(idx).cast("long").alias("i"))


def releases(df: DataFrame, key: str = "stream_id", idx: str = "idx", arrival: str = "arrival") -> DataFrame:
    """(key, idx, at, freed) per distinct piece: its first arrival, and the arrival with which it is written: the last of
    all first arrivals up to its index, or NULL while a smaller index is missing.

    All smaller indices are there where index and running count agree, so gaps need no look-up of their own.
    """
    first = df.where(F.col(idx) >= 0).groupBy(key, F.col(idx).cast("long").alias(idx)).agg(F.min(_when(idx, arrival)).alias("at"))
    out = O.with_running_sum(first, [key], [F.col(idx)], {"_n": F.lit(1)}, F.floor(F.col(idx) / 256), {"_last": F.col("at")})
    return out.select(key, idx, "at", F.when(F.col("_n") == F.col(idx) + 1, F.col("_last")).alias("freed"))


def occupancy(df: DataFrame, released: DataFrame, key: str = "stream_id", idx: str = "idx", arrival: str = "arrival") -> DataFrame:
    """(key, idx, at, held): for every arrival that has to wait, how many pieces wait already.

    Arrivals that wait count one up, releases one down; a running sum along the arrivals is the occupancy.  It holds up
    to the first time that a buffer is too small, for then a piece is lost.
    """
    waits = released.where("freed is null or freed > at")
    every = df.select(key, F.col(idx).cast("long").alias(idx), _when(idx, arrival).alias("again"))
    again = O.null_safe_join(waits, every, [key, idx]).where("at < again and (freed is null or again < freed)")
    events = (waits.select(key, idx, "at", F.lit(1).alias("_change"))
              .unionByName(again.select(key, idx, F.col("again").alias("at"), F.lit(0).alias("_change")))
              .unionByName(waits.where("freed is not null").select(
                  key, F.lit(None).cast("long").alias(idx), F.col("freed").alias("at"), F.lit(-1).alias("_change"))))
    events = O.with_density_bucket(events.withColumn("_at", F.col("at.at")), key, "_at")
    level = O.with_running_sum(events, [key], [F.col("at"), F.col("_change")], {"_level": F.col("_change")}, F.col("_bucket"))
    return level.where(F.col(idx).isNotNull()).select(key, idx, "at", (F.col("_level") - F.col("_change")).alias("held"))


_REPLAYED = "next_idx long, written long, bytes_written long, waiting long, dropped long"


def replayed(df: DataFrame, key: str = "stream_id", idx: str = "idx", arrival: str = "arrival", length: str = "length",
             max_waiting: int = rules.MAX_BUFFERED_SEGMENTS) -> DataFrame:
    """Streams written piece by piece as they arrive; per stream: next_idx, written, bytes_written, waiting, dropped.

    After a full buffer has lost a piece, what follows depends on every piece before it, so a stream is replayed in one
    task, row by row from narrow sorted rows; a task holds the lengths of at most ``max_waiting`` pieces.
    """
    key_type = df.schema[key].dataType.simpleString()

    def of(batches):
        at, state = (), None

        def row():
            held = state["held"]
            return (*at, state["next"], state["next"], state["bytes"], len(held), state["dropped"])

        for batch in batches:
            done = []
            for k, i, n in zip(*[batch.column(c).to_pylist() for c in (key, idx, length)], strict=True):
                if (k,) != at:
                    if state is not None:
                        done.append(row())
                    at, state = (k,), {"next": 0, "bytes": 0, "held": {}, "dropped": 0}
                if i > state["next"]:
                    if len(state["held"]) < max_waiting:
                        state["held"][i] = n
                    else:
                        state["dropped"] += 1
                elif i == state["next"]:
                    state["held"][i] = n
                    while state["next"] in state["held"]:
                        state["bytes"] += state["held"].pop(state["next"])
                        state["next"] += 1
            if done:
                yield made(done)
        if state is not None:
            yield made([row()])

    def made(rows):
        names = [key, *[f.split()[0] for f in _REPLAYED.split(", ")]]
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    schema = to_arrow_schema(T.StructType.fromDDL(f"`{key}` {key_type}, {_REPLAYED}"))
    rows = df.select(key, F.col(idx).cast("long").alias(idx), F.col(arrival).cast("long").alias(arrival), F.col(length).cast("long").alias(length))
    # by a hash of the key: an exchange on the key alone is dropped after a join on it, and the join may lose that order
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, arrival, idx).mapInArrow(of, f"`{key}` {key_type}, {_REPLAYED}")


def reassembly_summary(df: DataFrame, key: str = "stream_id", idx: str = "idx", arrival: str = "arrival",
                       max_waiting: int = rules.MAX_BUFFERED_SEGMENTS) -> DataFrame:
    """Per stream: contiguous length, pieces and bytes released, pieces waiting, pieces dropped, and overflow: whether a
    piece came while ``max_waiting`` others waited.  A repeat replaces a piece that still waits.

    Where no buffer overflows the outcome follows from :func:`releases`.  Only a stream of more than ``max_waiting`` pieces
    can overflow; those that do by :func:`occupancy` are replayed.
    """
    narrow = df.select(key, idx, arrival, F.octet_length("data").cast("long").alias("length"))
    released = releases(narrow, key, idx, arrival)
    sized = narrow.select(key, F.col(idx).cast("long").alias(idx), _when(idx, arrival).alias("came"), "length")
    pieces = O.null_safe_join(released, sized, [key, idx]).where("freed is null or came <= freed").groupBy(key, idx).agg(
        F.max("freed").alias("freed"), F.max_by("length", "came").alias("length"))
    wrote = F.col("freed").isNotNull()
    calm = pieces.groupBy(key).agg(
        F.coalesce(F.max(F.when(wrote, F.col(idx) + 1)), F.lit(0)).alias("next_idx"), F.count(F.when(wrote, 1)).alias("written"),
        F.sum(F.when(wrote, F.col("length")).otherwise(0)).cast("long").alias("bytes_written"),
        F.count(F.when(~wrote, 1)).alias("waiting"))
    many = narrow.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max_waiting).select(key)
    none = [F.lit(0).cast("long").alias("dropped"), F.lit(False).alias("overflow")]
    if many.isEmpty():
        return calm.select("*", *none)
    crowded = narrow.join(many, key, "left_semi")
    over = occupancy(crowded, releases(crowded, key, idx, arrival), key, idx, arrival)
    over = O.written(over.where(F.col("held") >= max_waiting).select(key).distinct(), "overflows")
    calm = calm.join(over, key, "left_anti").select("*", *none)
    full = replayed(narrow.join(over, key, "left_semi"), key, idx, arrival, max_waiting=max_waiting)
    return calm.unionByName(full.withColumn("overflow", F.lit(True)))


def with_offsets(df: DataFrame, key: str = "stream_id", idx: str = "idx", length: str = "length",
                 width: int = 256) -> DataFrame:
    """Byte offset of each segment in its stream's output, from narrow rows of (stream, index, length).

    With offsets known, ordered output needs no task that holds a whole stream.
    """
    out = O.with_running_sum(df, [key], [F.col(idx)], {"_end": F.col(length)}, F.floor(F.col(idx) / width))
    return out.withColumn("offset", F.col("_end") - F.col(length)).drop("_end")


def placed(df: DataFrame, key: str = "stream_id", idx: str = "idx", data: str = "data") -> DataFrame:
    """Segments with ``length`` and ``offset``; the bytes meet the offsets in one join and no window.  The input is
    read twice: write freshly filtered segments to a table first.  Repeated segments must be gone (``arrivals``)."""
    sized = df.select(key, idx, F.octet_length(data).cast("long").alias("length"))
    return O.null_safe_join(df, with_offsets(sized, key, idx), [key, idx])


def stream_digests(df: DataFrame, key: str = "stream_id", idx: str = "idx", data: str = "data") -> DataFrame:
    """Per stream, whatever its size: bytes, parts, and a digest of its ordered output that parts add up to: the sum
    of 32 bits of md5(offset, md5 of the part)."""
    sized = df.select(key, idx, F.octet_length(data).cast("long").alias("length"), F.md5(data).alias("part"))
    at = with_offsets(sized, key, idx)
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("offset").cast("string"), "part").cast("binary")), 1, 8), 16, 10)
    return at.groupBy(key).agg(F.sum("length").alias("bytes"), F.count("*").alias("parts"),
                               F.sum(word.cast("long")).alias("digest"))


def ordered_rows(df: DataFrame, key: str = "stream_id", idx: str = "idx") -> DataFrame:
    """Rows in output order: ranges of (stream, index), sorted within."""
    return df.repartitionByRange(key, idx).sortWithinPartitions(key, idx)


# ------------------------------------------------------------ accounting

def hls_stats(filtered: DataFrame, key: str = "stream_id", window: Column | None = None) -> DataFrame:
    """Stream counters from :func:`filter_segments` output; per ``window`` of a stream where one is given.

    Received bytes are counted after removal, as the segment path does.
    A NULL ``clean_data`` is a failed fetch: blocked, no bytes.
    """
    size = F.coalesce(F.octet_length("clean_data"), F.lit(0)).cast("long")
    ok = F.col("is_clean") & F.col("clean_data").isNotNull()
    out = filtered.groupBy(key, *([] if window is None else [window.alias("_w")])).agg(
        F.count("*").alias("total_segments"), F.count(F.when(ok, 1)).alias("clean_segments"),
        F.count(F.when(~ok, 1)).alias("blocked_segments"), F.sum(size).alias("bytes_received"),
        F.sum(F.when(ok, size).otherwise(0)).alias("bytes_written"),
        F.sum(F.when(~ok, size).otherwise(0)).alias("bytes_saved"), F.sum("duration").alias("duration_secs"))
    return out.drop("_w").withColumn("bytes_saved_pct", saved_pct(F.col("bytes_saved"), F.col("bytes_received")))


def chunk_stats(chunks: DataFrame, key: str = "stream_id", data: str = "data") -> DataFrame:
    """Counters of the chunk path: removed bytes count as saved."""
    got, kept = F.octet_length(data).cast("long"), F.octet_length("filtered").cast("long")
    out = chunks.groupBy(key).agg(
        F.sum(got).alias("bytes_received"), F.sum(kept).alias("bytes_written"), F.sum(got - kept).alias("bytes_saved"))
    return out.withColumn("bytes_saved_pct", saved_pct(F.col("bytes_saved"), F.col("bytes_received")))


def saved_pct(saved: Column, received: Column) -> Column:
    return F.when(received == 0, F.lit(0.0)).otherwise(saved / F.nullif(received, F.lit(0)) * 100)


def throughput_mbps(written: Column, millis: Column) -> Column:
    return F.when(millis == 0, F.lit(0.0)).otherwise(written / F.nullif(millis, F.lit(0)) * 1000 / (1024 * 1024))


def write_stats(df: DataFrame, key: str = "stream_id", data: str = "clean_data") -> DataFrame:
    """Bytes, chunks and errors per output."""
    return df.groupBy(key).agg(
        F.sum(F.when(F.col("is_clean"), F.octet_length(data)).otherwise(0)).cast("long").alias("bytes_written"),
        F.count(F.when(F.col("is_clean"), 1)).alias("chunks_written"),
        F.count(F.when(~F.col("is_clean"), 1)).alias("errors"))


def clean_streams(df: DataFrame, rule_set: list[Rule] = DEFAULT, url: str = "url", repair: bool = True) -> DataFrame:
    """Route each row by its stream kind: segment mode for HLS, chunk mode else.

    Both modes share one pass of the rules.  ``repair`` as in :func:`filter_segments`.
    """
    routed = df.withColumn("route", F.when(stream_type(F.col(url)) == "Hls", "segments").otherwise("chunks"))
    segs = filter_segments(routed.where("route = 'segments'"), rule_set, repair=repair).select(
        *routed.columns, "is_clean", "clean_data")
    chunks = filter_chunks(routed.where("route = 'chunks'"), rule_set).select(
        *routed.columns, F.lit(True).alias("is_clean"), F.col("filtered").alias("clean_data"))
    return segs.unionByName(chunks)


def chain(df: DataFrame, *processors) -> DataFrame:
    """Apply enabled processors in turn; each maps a DataFrame to a DataFrame."""
    for p in processors:
        if getattr(p, "is_enabled", True):
            df = df.transform(p)
    return df
