"""Streaming forms of the jobs, and a way to run one over finite input.

Builders take a streaming DataFrame and return one; sources, triggers and
sinks are the caller's.  Stateless jobs reuse the batch operators unchanged.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bytesieve import rules, session
from bytesieve.functions import ordered as O
from bytesieve.operators import segments, telemetry, triage
from bytesieve.plans import tables
from bytesieve.streaming.upserts import UpsertTable, newest

MAP_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ------------------------------------------------------------ running

def stream_given(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """A given table as a file stream, be it one file or a folder of them: a pattern that only its name matches, for a
    stream may not start at a plain file."""
    schema = tables.given(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(os.path.join(sf_dir, f"{name}.parque[t]"))


def stream_table(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """A derived table as a stream: the same projection over a streamed table."""
    text = tables.SOURCES[name]("spark")
    frames = {}
    for g in tables.GIVEN:
        if f"from {g}" in text:
            frames[g] = stream_given(spark, sf_dir, g, **options)
            text = text.replace(f"from {g}", "from {" + g + "}")
    return spark.sql(text, **frames)


class Replay:
    """Rows handed to a stream in steps along ``order``, each step what arrived since the one before; ``last`` may be one
    more step. Iterating appends the next step to the folder that ``stream`` reads."""

    def __init__(self, df: DataFrame, order: str, steps: int = 3, last: DataFrame | None = None):
        self.spark, self.schema, self.last = df.sparkSession, df.schema, last
        cuts = O.value_cuts(df, order, steps)
        self.steps = len(cuts) + 1
        self.stage, self.path = session.new_path(self.spark, "replay-stage"), session.new_path(self.spark, "replay")
        df.withColumn("_step", O.cut_tree(F.col(order), cuts)).write.partitionBy("_step").parquet(self.stage)
        self.spark.createDataFrame([], self.schema).write.parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def __iter__(self) -> Iterator[int]:
        staged = self.spark.read.parquet(self.stage)
        for i in range(self.steps):
            staged.where(F.col("_step") == i).select(self.schema.names).write.mode("append").parquet(self.path)
            yield i
        if self.last is not None:
            self.last.select(self.schema.names).write.mode("append").parquet(self.path)
            yield self.steps


def drain(df: DataFrame, save: Callable[[DataFrame, int], None], mode: str, replay: Replay | None) -> list[dict]:
    """Run a stream to the end of its input; with ``replay`` once per step on one checkpoint, as after a restart.
    Returns the progress of every micro-batch."""
    checkpoint, seen = session.new_path(df.sparkSession, "stream-state"), []
    for _ in replay if replay is not None else (0,):
        q = (df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        seen += [p if isinstance(p, dict) else p.jsonValue for p in q.recentProgress]
    return seen


def run(df: DataFrame, mode: str = "append", keys: list[str] | None = None, order: str | list[str] = "batch",
        per_batch: Callable[[DataFrame], DataFrame] | None = None, replay: Replay | None = None) -> DataFrame:
    """Drain a stream into parquet below the work folder and read it back.

    One folder per micro-batch, overwritten on a retry, so a batch that is run
    again after a failure is stored once.  With ``keys`` the result is the
    newest row per key (by ``order``, then by batch); complete mode keeps the newest batch.
    ``per_batch`` reduces each micro-batch before it is stored.
    """
    spark = df.sparkSession
    out = session.new_path(spark, "stream")
    spark.createDataFrame([], df.schema).write.parquet(os.path.join(out, "batch=-1"))

    def save(batch: DataFrame, batch_id: int) -> None:
        reduced = per_batch(batch) if per_batch else batch
        reduced.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    drain(df, save, mode, replay)
    rows = spark.read.parquet(out)
    if mode == "complete":
        newest_batch = rows.agg(F.max("batch").alias("batch"))
        rows = rows.join(F.broadcast(newest_batch), "batch", "left_semi")
    elif keys:
        values = [c for c in rows.columns if c not in keys]
        by = F.struct(*([order] if isinstance(order, str) else order), "batch")
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), by).alias("_v")).select(*keys, "_v.*")
    return rows.select(*df.columns)


def upsert(df: DataFrame, keys: list[str], order: list[str], replay: Replay | None = None, **kw) -> UpsertTable:
    """Drain a stream into a compacted table of the newest row per key."""
    table = UpsertTable(df.sparkSession, session.new_path(df.sparkSession, "upserts"), df.schema, keys, order, **kw)
    drain(df, table.save, "append", replay)
    return table


def timed(df: DataFrame, delay: str = "10 minutes", ts: str = "ts_us") -> DataFrame:
    """Add the event time column and its watermark."""
    return df.withColumn("ts", F.timestamp_micros(F.col(ts))).withWatermark("ts", delay)


# ------------------------------------------------------------ stateless

def triage_stream(files: DataFrame, **kw) -> DataFrame:
    """Verdicts for files as they arrive; needs header, path and score."""
    typed = triage.with_detected_type(files)
    return triage.with_verdict(triage.with_extension_facts(triage.with_extension(typed)), **kw)


def filter_stream(chunks: DataFrame, rule_set=rules.FILTER_RULES) -> DataFrame:
    return segments.filter_chunks(chunks, rule_set)


# ------------------------------------------------------------ windows and sessions

def speed_stream(transfers: DataFrame, millis: int) -> DataFrame:
    return telemetry.speed_windows(timed(transfers), millis)


def progress_stream(transfers: DataFrame, millis: int = 250) -> DataFrame:
    return telemetry.progress_windows(timed(transfers), millis)


def session_stream(requests: DataFrame, idle_secs: int = rules.IDLE_SECS, key: str = "host", delay: str = "10 minutes") -> DataFrame:
    """Sessions closed by ``idle_secs`` of silence; run in append mode.  A session leaves the state, and comes out, once
    the watermark has passed its end."""
    w = F.session_window("ts", f"{idle_secs} seconds")
    out = timed(requests, delay).groupBy(key, w).agg(
        F.count("*").alias("requests"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    return out.select(key, "start_us", "end_us", "requests")


def stats_stream(chunks: DataFrame, key: str = "stream_id", idle_secs: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """Segment counters of every stream; run in append mode.  A stream is over, its totals come out and leave the state,
    after ``idle_secs`` without a segment."""
    filtered = segments.filter_segments(timed(chunks, delay))
    return segments.hls_stats(filtered, key, F.session_window("ts", f"{idle_secs} seconds"))


def closing(df: DataFrame, ts: str = "ts_us", after_secs: int = 2 * 86_400) -> DataFrame:
    """One row of nulls but for a time past all others: as a last step it moves the watermark over everything open, so
    that all of it comes out.  Its own session stays open."""
    top = df.agg(F.max(ts).alias(ts)).withColumn(ts, F.col(ts) + after_secs * 1_000_000)
    return top.select(*[F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])


# ------------------------------------------------------------ latest value per key

def newest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row per key; used per micro-batch ahead of an upsert sink.

    Run on each batch (``run(..., per_batch=...)``) it leaves the query
    stateless: the stored table is the state, folded on the same order when
    read, and keys that stop changing cost nothing.
    """
    return newest(df, [key], order)


def drop_expired(states: DataFrame, at: str = "saved_at", ttl_secs: int = rules.RESUME_TTL_SECS) -> DataFrame:
    """Keep states younger than the TTL, counted back from the newest one."""
    newest = states.agg(F.max(at).alias("now")).scalar()
    return states.where(newest - F.col(at) < ttl_secs)


# ------------------------------------------------------------ custom state

def use_map_state(spark: SparkSession) -> None:
    """Keyed state cells need a state store that holds several per key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", MAP_STATE)


class Reassembler(StatefulProcessor):
    """One state cell per waiting piece, and per stream the next index, how many wait and the timer that runs."""

    def __init__(self, key: str, max_waiting: int, gap_timeout_ms: int | None):
        self.key, self.max_waiting, self.gap_timeout_ms = key, max_waiting, gap_timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "expected long, held long, timer long")
        self.waiting = handle.getMapState("waiting", "idx long", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expected, held, timer = self.place.get() or (0, 0, -1)
        stored = {k[0] for k in self.waiting.keys()} if held else set()
        fresh: dict[int, bytes] = {}  # came now and wait, at most as many as may; what is released now never is a state cell
        for chunk in rows:
            out = []
            ordered = chunk.sort_values(["arrival", "idx"], kind="stable")
            for idx, data in zip(ordered["idx"].tolist(), ordered["data"], strict=True):
                if idx > expected:
                    if held >= self.max_waiting:
                        out.append((key[0], idx, None, "overflow", bytes(data)))
                    elif idx in stored:
                        self.waiting.updateValue((idx,), (bytes(data),))
                    else:
                        held += idx not in fresh
                        fresh[idx] = bytes(data)
                elif idx == expected:
                    out.append((key[0], idx, expected, "written", bytes(data)))
                    expected += 1
                    while expected in fresh or expected in stored:
                        if expected in fresh:
                            piece = fresh.pop(expected)
                        else:
                            piece = self.waiting.getValue((expected,))[0]
                            self.waiting.removeKey((expected,))
                            stored.discard(expected)
                        out.append((key[0], expected, expected, "written", piece))
                        expected, held = expected + 1, held - 1
            yield self.rows(out)
        for idx, data in fresh.items():
            self.waiting.updateValue((idx,), (data,))
        if self.gap_timeout_ms:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = -1
            if held:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.gap_timeout_ms
                self.handle.registerTimer(timer)
        self.place.update((expected, held, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.waiting.clear()
        self.place.clear()
        yield self.rows([(key[0], None, None, "gap", None)])

    def rows(self, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=[self.key, "idx", "release_no", "outcome", "data"])
        return out.astype({"idx": "Int64", "release_no": "Int64"})


def reassemble_stream(chunks: DataFrame, key: str = "stream_id", max_waiting: int = rules.MAX_BUFFERED_SEGMENTS,
                      gap_timeout_ms: int | None = None) -> DataFrame:
    """Release segments in index order per stream.

    Needs ``stream_id, idx, arrival, data``.  Rows of a stream are taken chunk by chunk as Spark hands them over, each
    chunk by (arrival, idx); a micro-batch is never gathered.  A piece ahead of its turn is one state cell, written when it
    comes and dropped when it goes; beyond ``max_waiting`` of them a piece comes out with its bytes as an ``overflow`` row
    instead of growing the state.  Segments older than the next index are dropped.  With ``gap_timeout_ms`` a stream stuck
    on a gap gives up its state after that silence (for long-running triggers: a processing-time timer keeps an
    available-now run from ever ending).
    """
    use_map_state(chunks.sparkSession)
    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, "idx", "arrival", "data").groupBy(key).transformWithStateInPandas(
        Reassembler(key, max_waiting, gap_timeout_ms), f"`{key}` {kind}, idx long, release_no long, outcome string, data binary",
        "append", "ProcessingTime" if gap_timeout_ms else "None")


class LevelChanges(StatefulProcessor):
    """The last level of every key.  Spark hands over a key's rows of a micro-batch in chunks of no order, so they are put
    in order as a whole, three numbers a row: the micro-batch bounds what a task holds."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "level int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (last,) = self.last.get() or (0,)
        ordered = pd.concat([c[["ts_us", "event_id", "level"]] for c in rows]).sort_values(["ts_us", "event_id"])
        before = ordered["level"].shift(1, fill_value=last)
        changed = ordered.assign(prev_level=before, **{self.key: key[0]})[ordered["level"] != before]
        self.last.update((int(ordered["level"].iloc[-1]),))
        yield changed[[self.key, "ts_us", "event_id", "prev_level", "level"]].astype({"prev_level": "int32"})


def level_change_stream(metrics: DataFrame, key: str = "host") -> DataFrame:
    """Emit a host's row whenever its level differs from the one before, each micro-batch in the order of time.  For small
    micro-batches: a host's rows go to one task.  :func:`level_changes` spreads them."""
    use_map_state(metrics.sparkSession)
    kind = metrics.schema[key].dataType.simpleString()
    return metrics.select(key, "ts_us", "event_id", "level").groupBy(key).transformWithStateInPandas(
        LevelChanges(key), f"`{key}` {kind}, ts_us long, event_id long, prev_level int, level int", "append", "None")


def level_changes(metrics: DataFrame, replay: Replay | None = None, key: str = "host") -> DataFrame:
    """The rows of :func:`level_change_stream`, drained, for micro-batches and hosts of any size.

    Each micro-batch is ordered in (host, bucket) windows, and its first rows meet the hosts' last levels of the micro-batch
    before.  Changes and last levels are one folder per micro-batch, overwritten on a retry.
    """
    spark, order = metrics.sparkSession, ["ts_us", "event_id"]
    narrow = metrics.select(key, *order, "level")
    out, state = session.new_path(spark, "levels"), session.new_path(spark, "last-levels")
    last_schema = narrow.select(key, F.col("level").alias("last")).schema
    spark.createDataFrame([], last_schema).write.parquet(os.path.join(state, "batch=-1"))

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = O.written(batch, "level-rows")
        last = spark.read.schema(last_schema).parquet(os.path.join(state, f"batch={batch_id - 1}"))
        prev = O.null_safe_join(O.with_previous(rows, key, order, ["level"]), last, [key], "left")
        prev = prev.withColumn("prev_level", F.coalesce("prev_level", "last", F.lit(0)))
        prev.where("level <> prev_level").select(key, *order, "prev_level", "level").write.mode("overwrite").parquet(
            os.path.join(out, f"batch={batch_id}"))
        newest = rows.groupBy(key).agg(F.max_by("level", F.struct(*order)).alias("now"))
        both = last.withColumn("now", F.lit(None).cast("int")).unionByName(newest.withColumn("last", F.lit(None).cast("int")))
        both.groupBy(key).agg(F.coalesce(F.max("now"), F.max("last")).alias("last")).write.mode("overwrite").parquet(
            os.path.join(state, f"batch={batch_id}"))

    schema = narrow.withColumn("prev_level", F.col("level")).select(key, *order, "prev_level", "level").schema
    spark.createDataFrame([], schema).write.parquet(os.path.join(out, "batch=-1"))
    drain(narrow, save, "append", replay)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
