"""Streams in several micro-batches give the batch result."""

import random
import time

from pyspark.sql import functions as F

from bytesieve.operators import segments as sg
from bytesieve.operators import telemetry as te
from bytesieve.streaming import jobs
from bytesieve.streaming.upserts import UpsertTable


def split_files(spark, path, rows, schema, files):
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_reassembly_across_batches(spark, tmp_path):
    rng = random.Random(4)
    order = list(range(30))
    for i in range(0, 30, 5):
        part = order[i:i + 5]
        rng.shuffle(part)
        order[i:i + 5] = part
    rows = [(1, idx, n, bytearray(str(idx).encode())) for n, idx in enumerate(order)]
    schema = "stream_id long, idx long, arrival long, data binary"
    path = tmp_path / "in"
    for i in range(0, 30, 6):  # arrival order kept across files
        spark.createDataFrame(rows[i:i + 6], schema).coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    out = jobs.run(jobs.reassemble_stream(stream))
    got = sorted((r.release_no, r.idx, bytes(r.data)) for r in out.collect())
    assert got == [(i, i, str(i).encode()) for i in range(30)]


def test_reassembly_overflow_and_old(spark, tmp_path):
    rows = [(1, i, n, bytearray(b"x")) for n, i in enumerate([0, *range(2, 15), 0, 1])]
    stream = split_files(spark, tmp_path / "in", rows, "stream_id long, idx long, arrival long, data binary", 1)
    out = jobs.run(jobs.reassemble_stream(stream)).collect()
    assert sorted(r.idx for r in out if r.outcome == "written") == list(range(12))
    assert sorted(r.idx for r in out if r.outcome == "overflow") == [12, 13, 14]


def test_windows_levels_and_status_across_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, i % 3, i * 137_000, rng.randrange(5000), float(rng.randrange(100)), float(rng.randrange(100))) for i in range(600)]
    schema = "event_id long, task_id long, ts_us long, chunk_bytes long, ram_pct double, cpu_pct double"
    path = tmp_path / "in"
    for i in range(0, 600, 150):
        spark.createDataFrame(rows[i:i + 150], schema).coalesce(1).write.mode("append").parquet(str(path))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    batch = spark.read.schema(schema).parquet(str(path))
    key = lambda df: sorted(map(tuple, df.collect()))

    got = jobs.run(jobs.speed_stream(read(), 1000), "update", ["task_id", "window_us"])
    want = te.speed_windows(batch.withColumn("ts", F.timestamp_micros("ts_us")), 1000)
    assert key(got) == key(want)

    leveled = lambda d: te.with_level(d).withColumn("host", F.col("task_id"))
    files = sorted(r[0] for r in batch.select(F.input_file_name()).distinct().collect())
    assert len(files) >= 4
    got = jobs.run(jobs.level_change_stream(leveled(read())))
    want = te.level_changes(leveled(batch)).select("host", "ts_us", "event_id", "prev_level", "level")
    assert key(got) == key(want)

    newest = jobs.run(read().select("task_id", "ts_us", "event_id"), keys=["task_id"], order="ts_us",
                      per_batch=lambda b: jobs.newest_per_key(b, "task_id", ["ts_us"]))
    assert sorted(r.event_id for r in newest.collect()) == [597, 598, 599]


def test_gap_timeout_releases_state(spark, tmp_path):
    rows = [(1, 5, 0, bytearray(b"x"))]
    stream = split_files(spark, tmp_path / "in", rows, "stream_id long, idx long, arrival long, data binary", 1)
    seen = []
    q = (jobs.reassemble_stream(stream, gap_timeout_ms=500).writeStream.outputMode("append")
         .foreachBatch(lambda b, _: seen.extend(r.outcome for r in b.collect()))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="1 second").start())
    try:
        for _ in range(60):
            if seen or q.exception():
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert seen == ["gap"]


def test_expiry(spark):
    df = spark.createDataFrame([("a", 0), ("b", 604799), ("c", 604800)], "output_path string, saved_at long")
    assert sorted(r.output_path for r in jobs.drop_expired(df).collect()) == ["b", "c"]


def test_sessions_leave_the_state(spark):
    """Append mode: state rows fall as the watermark passes; the closing step lets the last sessions out."""
    rows = [(h, (h * 7 + k * 600 + (k // 3) * 20_000) * 1_000_000, k) for h in range(30) for k in range(12)]
    df = spark.createDataFrame(rows, "host long, ts_us long, event_id long")
    replay = jobs.Replay(df, "ts_us", 4, last=jobs.closing(df))
    kept = []
    stream = jobs.session_stream(replay.stream(), 900)
    seen = jobs.drain(stream, lambda batch, _: kept.extend(batch.collect()), "append", replay)
    left = [p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]]
    assert max(left) >= 30 and left[-1] == 1  # the closing row's own
    want = te.idle_sessions(df, idle_secs=900)
    assert sorted((r.host, r.start_us, r.end_us, r.requests) for r in kept) == sorted(
        (r.host, r.start_us, r.end_us, r.requests) for r in want.collect())


def test_upserts_stay_compact(spark, tmp_path):
    """50 batches with late and tied saves: few files at any time, one answer, retries change nothing."""
    rng = random.Random(6)
    schema = spark.createDataFrame([], "k long, at long, v long").schema
    table = UpsertTable(spark, str(tmp_path / "t"), schema, ["k"], ["at"], deltas=4, buckets=2)
    best = {}
    for b in range(50):
        rows = [(rng.randrange(6), rng.randrange(40), rng.randrange(9)) for _ in range(5)]
        for k, at, v in rows:
            best[k] = max(best.get(k, (-1, -1)), (at, v))
        df = spark.createDataFrame(rows, schema).coalesce(1)
        table.save(df, b)
        if b % 10 == 3:
            table.save(spark.createDataFrame([(0, 999, 999)], schema), b)  # the same batch again
        folders = [p for p in (tmp_path / "t").iterdir() if p.is_dir()]
        assert len(folders) <= 4
        assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 4 * 2 + 2
    assert {r.k: (r.at, r.v) for r in table.read().collect()} == best


def test_pieces_are_state_cells(spark, tmp_path):
    """What waits is one state row a piece, and rows go as pieces are released."""
    schema = "stream_id long, idx long, arrival long, data binary"
    rows = [(1, i, n, bytearray(b"x")) for n, i in enumerate([3, 2, 1, 5, 0, 4])]
    df = spark.createDataFrame(rows, schema)
    replay = jobs.Replay(df, "arrival", 6)
    out = []
    seen = jobs.drain(jobs.reassemble_stream(replay.stream()), lambda b, _: out.extend(b.collect()), "append", replay)
    assert [r.idx for r in out] == [0, 1, 2, 3, 4, 5]
    assert [p["stateOperators"][0]["numRowsTotal"] for p in seen if p["numInputRows"]] == [2, 3, 4, 5, 2, 1]


def test_stream_and_batch_agree(spark, tmp_path):
    """Late, lost and repeated pieces in a stream that overflows and closes its gap later."""
    order = [1, 2, 3, 4, 2, 0, 3, 6, 7, 8, 9, 5, 4]
    rows = [(1, i, n, bytearray(b"ab" * (n + 1))) for n, i in enumerate(order)]
    df = spark.createDataFrame(rows, "stream_id long, idx long, arrival long, data binary")
    replay = jobs.Replay(df, "arrival", 5)
    out = jobs.run(jobs.reassemble_stream(replay.stream(), max_waiting=3), replay=replay).collect()
    r = sg.reassembly_summary(df, max_waiting=3).first()
    written = [x for x in out if x.outcome == "written"]
    assert (r.written, r.bytes_written, r.dropped) == (
        len(written), sum(len(x.data) for x in written), sum(x.outcome == "overflow" for x in out))
    assert r.overflow and r.next_idx == max(x.idx for x in written) + 1


def test_given_table_as_file_or_folder(spark, tmp_path):
    """A table stored as a folder of parts streams as whole as one stored as a single file."""
    df = spark.range(40).withColumnRenamed("id", "conv_id")
    df.repartition(4).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "file" / "conversations.parquet")
    for kind in ("folder", "file"):
        got = jobs.run(jobs.stream_given(spark, str(tmp_path / kind), "conversations"))
        assert sorted(r.conv_id for r in got.collect()) == list(range(40)), kind


def test_level_changes_of_a_large_micro_batch(spark):
    """More rows of a host than one chunk holds, stored in no order of time, in one micro-batch and in several."""
    df = te.with_level(spark.range(30_000).select(
        F.col("id").alias("event_id"), (F.col("id") % 2).alias("host"), (F.col("id") * 7919 % 15_013 * 1000).alias("ts_us"),
        (F.col("id") * 31 % 100).cast("double").alias("ram_pct"), F.lit(0.0).alias("cpu_pct")))
    key = lambda d: sorted(map(tuple, d.select("host", "ts_us", "event_id", "prev_level", "level").collect()))
    want = key(te.level_changes(df))
    for steps in (1, 3):
        replay = jobs.Replay(df, "ts_us", steps)
        assert key(jobs.level_changes(replay.stream(), replay)) == want
    replay = jobs.Replay(df, "ts_us", 1)
    assert key(jobs.run(jobs.level_change_stream(replay.stream()), replay=replay)) == want
