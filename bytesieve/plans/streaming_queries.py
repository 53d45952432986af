"""Streaming jobs drained over the given tables.

Each query runs a real streaming query to completion and returns what it
wrote; its SQL twin is the batch meaning of the same job.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.operators import telemetry
from bytesieve.plans import registry
from bytesieve.plans.evaluation_queries import rounded
from bytesieve.plans.registry import query
from bytesieve.plans.segment_queries import _GAP, arrived
from bytesieve.plans.tables import cte
from bytesieve.plans.telemetry_queries import _LOG, as_log
from bytesieve.plans.triage_queries import _VERDICT
from bytesieve.streaming import jobs

O = registry.ORACLES


@query("st_triage", _VERDICT + " select file_id, verdict, confidence, threat_name from v")
def st_triage(spark, sf):
    files = jobs.stream_table(spark, sf, "files").select(
        "file_id", "path", F.substring("content", 1, rules.HEADER_SIZE).alias("header"),
        (F.col("file_id") * 37 % 101 / F.lit(100.0)).alias("score"))
    out = jobs.triage_stream(files, warn_threshold=0.6).select(
        "file_id", "verdict", F.round("confidence", 6).alias("confidence"), "threat_name")
    return jobs.run(out)


@query("st_filter_chunks", O["filter_chunk"])
def st_filter_chunks(spark, sf):
    out = jobs.filter_stream(jobs.stream_table(spark, sf, "segments")).select(
        "stream_id", "idx", "blocked_by", F.md5("filtered").alias("digest"),
        F.octet_length("filtered").cast("long").alias("kept_bytes"))
    return jobs.run(out)


def _speed_sql(millis: int) -> str:
    us = millis * 1000
    return cte("transfers") + f""" select task_id, ts_us // {us} * {us} as window_us, sum(chunk_bytes)::bigint as bytes, count(*) as chunks,
      floor(sum(chunk_bytes) / (1024.0::double * {millis} / 1000))::bigint as speed_kbps from transfers group by 1, 2"""


@query("st_speed_1s", _speed_sql(1000))
def st_speed_1s(spark, sf):
    return jobs.run(jobs.speed_stream(jobs.stream_table(spark, sf, "transfers"), 1000), "update", ["task_id", "window_us"])


@query("st_speed_500ms", _speed_sql(500))
def st_speed_500ms(spark, sf):
    return jobs.run(jobs.speed_stream(jobs.stream_table(spark, sf, "transfers"), 500), "update", ["task_id", "window_us"])


@query("speed_by_hour", _speed_sql(3600000))
def speed_by_hour(spark, sf):
    """The same window job on batch input, one hour wide."""
    df = jobs.tables.table(spark, sf, "transfers").withColumn("ts", F.timestamp_micros("ts_us"))
    return telemetry.speed_windows(df, 3600000)


@query("st_progress_250ms", cte("transfers") + """ select task_id, ts_us // 250000 * 250000 as window_us,
  arg_max(value / 500, (ts_us, event_id)) as progress from transfers group by 1, 2""")
def st_progress_250ms(spark, sf):
    t = jobs.stream_table(spark, sf, "transfers").withColumn("progress", F.col("value") / 500)
    return jobs.run(jobs.progress_stream(t), "update", ["task_id", "window_us"])


@query("st_stream_stats", O["stream_stats"].replace(
    ",\n  round(coalesce(sum(cn) filter (ok), 0) / 250.0::double * 1000 / 1048576, 6) as mbps", ""))
def st_stream_stats(spark, sf):
    """Segments in three steps, ten seconds apart in a stream; totals come out as streams fall silent."""
    segs = jobs.tables.table(spark, sf, "segments").withColumn("ts_us", (F.col("stream_id") * 100 + F.col("idx") * 10) * 1_000_000)
    replay = jobs.Replay(segs, "ts_us", last=jobs.closing(segs))
    return rounded(jobs.run(jobs.stats_stream(replay.stream()), replay=replay))


@query("st_reassembly", _GAP + """ select stream_id, idx, idx as release_no, 'written' as outcome, md5(data) as digest
  from a join g using (stream_id) where idx < next_idx""")
def st_reassembly(spark, sf):
    """Segments arrive out of order and with losses, in two steps with a restart between."""
    replay = jobs.Replay(arrived(spark, sf), "arrival", 2)
    out = jobs.run(jobs.reassemble_stream(replay.stream()), replay=replay)
    return out.select("stream_id", "idx", "release_no", "outcome", F.md5("data").alias("digest"))


@query("st_latest_status", _LOG + """ select task_id, arg_max(status, (ts_us, event_id)) as status,
  arg_max(status, (ts_us, event_id)) in ('Complete', 'Blocked', 'Cancelled', 'Failed') as is_terminal from log group by 1""")
def st_latest_status(spark, sf):
    log = as_log(jobs.stream_table(spark, sf, "transfers"))
    out = jobs.run(log.select("task_id", "ts_us", "event_id", "status"), keys=["task_id"], order=["ts_us", "event_id"],
                   per_batch=lambda b: jobs.newest_per_key(b, "task_id", ["ts_us", "event_id"]))
    return out.select("task_id", "status", F.col("status").isin(rules.TERMINAL_STATUSES).alias("is_terminal"))


@query("st_resume_state", cte("resume_saves") + """, s as (select output_path, arg_max(bytes_downloaded, (saved_at, bytes_downloaded)) as bytes_downloaded,
    max(saved_at) as saved_at from resume_saves group by 1)
  select output_path, bytes_downloaded, saved_at from s where (select max(saved_at) from s) - saved_at < 604800""")
def st_resume_state(spark, sf):
    """Saves in three steps, upserted into one compacted table."""
    saves = jobs.tables.table(spark, sf, "resume_saves").select("output_path", "bytes_downloaded", "saved_at")
    replay = jobs.Replay(saves, "saved_at")
    return jobs.drop_expired(jobs.upsert(replay.stream(), ["output_path"], ["saved_at"], replay, deltas=2).read())


@query("st_level_changes", O["level_changes"])
def st_level_changes(spark, sf):
    replay = jobs.Replay(jobs.tables.table(spark, sf, "sys_metrics"), "ts_us")
    return jobs.level_changes(telemetry.with_level(replay.stream()), replay)


@query("st_idle_sessions", O["idle_sessions"].replace("select host, session, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as requests from n group by 1, 2",
    "select host, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as requests from n group by host, session"))
def st_idle_sessions(spark, sf):
    """Append mode: sessions leave the state as the watermark passes, the last ones by a closing step."""
    req = jobs.tables.table(spark, sf, "requests").withColumn("host", telemetry.host_of(F.col("url")))
    replay = jobs.Replay(req, "ts_us", last=jobs.closing(req))
    return jobs.run(jobs.session_stream(replay.stream()), replay=replay)
