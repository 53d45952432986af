"""Transfer telemetry: progress, states, resume positions, hosts, resources, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.functions import ordered as O
from bytesieve.functions import text as T
from bytesieve.operators import dims

SECOND_US = 1_000_000


# ------------------------------------------------------------ progress

def _eta(total: Column, done: Column, speed: Column) -> Column:
    kib = F.greatest(total - done, F.lit(0)) / 1024.0
    return F.floor(kib / F.nullif(speed, F.lit(0)))


def with_progress(df: DataFrame) -> DataFrame:
    """Task form: share done and whole seconds left (0 when unknown)."""
    total, done, speed = F.col("total_bytes"), F.col("done_bytes"), F.col("speed_kbps")
    return df.withColumn("progress", F.when(total > 0, done / F.nullif(total, F.lit(0))).otherwise(0.0)).withColumn(
        "eta_secs", F.when((speed > 0) & (total > done), _eta(total, done, speed)).otherwise(F.lit(0)))


def with_percentage(df: DataFrame) -> DataFrame:
    """Transfer form: percentage, saturating remainder and clock text."""
    total, done, speed = F.col("total_bytes"), F.col("done_bytes"), F.col("speed_kbps")
    return (
        df.withColumn("percentage", F.when(total > 0, done / F.nullif(total, F.lit(0)) * 100).otherwise(0.0))
        .withColumn("eta_secs", F.when((total > 0) & (speed > 0), _eta(total, done, speed)).otherwise(F.lit(0)))
        .withColumn("eta_text", T.eta_text(F.col("eta_secs")))
    )


def with_duration(df: DataFrame) -> DataFrame:
    """Whole seconds taken and integer average speed (0 when unknown)."""
    secs = F.expr("(completed_us - started_us) div 1000000")
    return df.withColumn("duration_secs", secs).withColumn(
        "average_kbps", F.when(F.col("duration_secs") > 0, F.expr("done_bytes div (duration_secs * 1024)")).otherwise(
            F.lit(0).cast("long")))


def with_status_facts(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(dims.statuses(df.sparkSession)), "status", "left")


def status_timeline(log: DataFrame, key: str = "task_id", ts: str = "ts_us") -> DataFrame:
    """Current state per task from its transition log; the last write wins."""
    s, t = F.col("status"), F.col(ts)
    last = lambda v, *states: F.max_by(F.when(s.isin(*states), F.col(v)), F.when(s.isin(*states), F.struct(ts, "event_id")))
    return log.groupBy(key).agg(
        F.max_by("status", F.struct(ts, "event_id")).alias("status"),
        F.max(F.when(s == "Downloading", t)).alias("started_us"),
        F.max(F.when(s.isin("Complete", "Failed", "Blocked"), t)).alias("completed_us"),
        last("detail", "Failed").alias("error"), last("detail", "Blocked").alias("scan_verdict"),
        F.count("*").alias("changes"))


def cancel(tasks: DataFrame, ids: DataFrame, key: str = "task_id") -> DataFrame:
    """Set the listed tasks to Cancelled, whatever their state."""
    marks = ids.select(key).distinct().withColumn("_c", F.lit(True))
    return tasks.join(marks, key, "left").withColumn(
        "status", F.when(F.col("_c"), "Cancelled").otherwise(F.col("status"))).drop("_c")


def progress_of(ids: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Progress per asked id; 0 for ids without a task."""
    return ids.join(tasks.select(key, "progress"), key, "left").withColumn(
        "progress", F.coalesce("progress", F.lit(0.0)))


# ------------------------------------------------------------ responses and resume

def resumable(accept_ranges: Column, content_length: Column) -> Column:
    return F.coalesce(accept_ranges == "bytes", F.lit(False)) & content_length.isNotNull()


def disposition_filename(header: Column) -> Column:
    part = F.get(F.filter(F.split(header, ";"), lambda s: F.startswith(F.trim(s), F.lit("filename"))), F.lit(0))
    return F.regexp_replace(F.trim(F.get(F.split(part, "="), F.lit(1))), '^"+|"+$', "")


def latest_states(saves: DataFrame, cleared: DataFrame | None = None, key: str = "output_path",
                  at: str = "saved_at") -> DataFrame:
    """Last saved state per path, minus cleared paths."""
    values = [c for c in saves.columns if c != key]
    order = F.struct(at, *[c for c in values if c != at])
    out = saves.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_s")).select(key, "_s.*")
    return out if cleared is None else out.join(cleared.select(key), key, "left_anti")


def is_recent(saved_at: Column, now: int) -> Column:
    return F.greatest(F.lit(now) - saved_at, F.lit(0)) < rules.RESUME_TTL_SECS


def resume_offsets(states: DataFrame, listing: DataFrame, now: int, key: str = "output_path") -> DataFrame:
    """Saved bytes where the state is fresh and the file on disk has that size, else 0."""
    ok = is_recent(F.col("saved_at"), now) & (F.col("size") == F.col("bytes_downloaded"))
    return states.join(listing.select(key, "size"), key, "left").withColumn(
        "offset", F.when(ok, F.col("bytes_downloaded")).otherwise(F.lit(0))).withColumn(
        "can_resume", F.col("offset") > 0)


def resume_progress(bytes_done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(bytes_done / F.nullif(total, F.lit(0)) * 100)


def validate_states(paths: DataFrame, states: DataFrame, key: str = "output_path") -> DataFrame:
    """False without a state or when both ETags are known and differ."""
    s = states.select(key, F.col("etag").alias("_state_etag"), F.lit(True).alias("_known"))
    return paths.join(s, key, "left").withColumn(
        "valid", F.col("_known").isNotNull() & F.coalesce(F.col("_state_etag") == F.col("etag"), F.lit(True))
    ).drop("_known", "_state_etag")


def retry_profile(attempts: DataFrame, key: str = "task_id", max_retries: int = rules.MAX_RETRIES,
                  delay_ms: int = rules.RETRY_DELAY_MS) -> DataFrame:
    """Per task: failures, retries spent, total wait and whether retries ran out."""
    n = F.count(F.when(~F.col("succeeded"), 1))
    out = attempts.groupBy(key).agg(F.count("*").alias("attempts"), n.alias("failures"))
    return out.withColumn("retries", F.least("failures", F.lit(max_retries))).withColumn(
        "backoff_ms", (F.lit(delay_ms) * F.col("retries") * (F.col("retries") + 1) / 2).cast("long")).withColumn(
        "exhausted", F.col("failures") > max_retries)


# ------------------------------------------------------------ hosts

def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)


def pool_stats(requests: DataFrame) -> DataFrame:
    """Reuse and connection counts per host."""
    hits = F.count(F.when(F.col("hit"), 1))
    out = requests.groupBy(host_of(F.col("url")).alias("host")).agg(
        F.count("*").alias("total_requests"), hits.alias("cache_hits"), (F.count("*") - hits).alias("cache_misses"),
        F.count(F.when(F.col("in_use"), 1)).alias("active"), F.count(F.when(~F.col("in_use"), 1)).alias("idle"))
    total = F.col("cache_hits") + F.col("cache_misses")
    return out.withColumn("hit_rate", F.when(total == 0, 0.0).otherwise(F.col("cache_hits") / total * 100))


def idle_sessions(df: DataFrame, key: str = "host", ts: str = "ts_us", tie: str = "event_id",
                  idle_secs: int = rules.IDLE_SECS, rows_per_bucket: int = O.ROWS_PER_BUCKET) -> DataFrame:
    """Sessions split where a host stayed silent longer than ``idle_secs``.

    One shuffle of rows: sessions are cut inside (host, bucket).  Only the first and last session of a bucket can go on
    in another one, so at most two rows per bucket are put in order across buckets; numbers are a running count over
    buckets of sessions.
    """
    limit = idle_secs * SECOND_US
    rows = O.with_density_bucket(df.select(key, ts, tie), key, ts, rows=rows_per_bucket)
    inside = Window.partitionBy(key, "_bucket").orderBy(ts, tie)
    new = F.coalesce((F.col(ts) - F.lag(ts).over(inside) > limit).cast("int"), F.lit(0))
    local = rows.select(key, "_bucket", ts, tie, new.alias("_new")).withColumn(
        "_s", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = local.groupBy(key, "_bucket", "_s").agg(
        F.min(ts).alias("start_us"), F.max(ts).alias("end_us"), F.count("*").alias("requests"))
    last = F.max("_s").over(Window.partitionBy(key, "_bucket"))
    parts = parts.withColumn("_border", (F.col("_s") == 0) | (F.col("_s") == last))
    across = Window.partitionBy(key).orderBy("_bucket", "_s")
    border = parts.where("_border").withColumn("_gap", F.coalesce(
        (F.col("_s") > 0) | (F.col("start_us") - F.lag("end_us").over(across) > limit), F.lit(False)))
    border = border.withColumn("_run", F.sum(F.col("_gap").cast("int")).over(
        across.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = border.groupBy(key, "_run").agg(
        F.min("_bucket").alias("_bucket"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.sum("requests").alias("requests")).drop("_run")
    sessions = parts.where("not _border").select(*whole.columns).unionByName(whole)
    return O.with_running_sum(sessions, [key], [F.col("start_us")], {"session": F.lit(1).cast("long")}, F.col("_bucket")).select(
        key, "session", "start_us", "end_us", "requests")


# ------------------------------------------------------------ resources

def _ladder(pct: Column, cuts: tuple) -> Column:
    out = F.lit(0)
    for level, cut in enumerate(cuts, start=1):
        out = F.when(pct >= cut, level).otherwise(out)
    return out


def resource_level(ram_pct: Column, cpu_pct: Column) -> Column:
    """The worse of the RAM and CPU levels, 0 (Low) to 3 (Critical)."""
    return F.greatest(_ladder(ram_pct, rules.RAM_CUTS), _ladder(cpu_pct, rules.CPU_CUTS))


def with_level(df: DataFrame, ram: str = "ram_pct", cpu: str = "cpu_pct") -> DataFrame:
    return df.withColumn("level", resource_level(F.col(ram), F.col(cpu)))


def with_level_facts(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(dims.resource_levels(df.sparkSession)), "level", "left")


def level_changes(df: DataFrame, key: str = "host", ts: str = "ts_us", tie: str = "event_id",
                  rows_per_bucket: int = O.ROWS_PER_BUCKET) -> DataFrame:
    """Rows whose level differs from the one before; hosts start at Low."""
    prev = O.with_previous(df, key, [ts, tie], ["level"], rows_per_bucket=rows_per_bucket)
    return prev.withColumn("prev_level", F.coalesce("prev_level", F.lit(0))).where("level <> prev_level")


def memory_stats(df: DataFrame, key: str = "host") -> DataFrame:
    mb = 1024 * 1024
    pct = F.when(F.col("total_bytes") > 0, F.col("used_bytes") / F.nullif("total_bytes", F.lit(0)) * 100).otherwise(0.0)
    used, total = F.floor(F.col("used_bytes") / mb), F.floor(F.col("total_bytes") / mb)
    return df.groupBy(key).agg(
        F.avg(pct).alias("mean_ram_pct"), F.max(used).alias("peak_used_mb"), F.max(total).alias("total_mb"),
        F.min(F.greatest(total - used, F.lit(0))).alias("least_free_mb"), F.avg("cpu_pct").alias("mean_cpu_pct"),
        F.count(F.when(pct >= rules.RAM_CRITICAL_PCT, 1)).alias("critical_samples"))


# ------------------------------------------------------------ errors and history

def error_taxonomy(errors: DataFrame) -> DataFrame:
    """Errors per category with their recoverable and security flags; kinds that are not listed are one category,
    neither recoverable nor of security."""
    counts = errors.groupBy("error_kind").agg(F.count("*").alias("errors"))
    return counts.join(F.broadcast(dims.error_kinds(errors.sparkSession)), "error_kind", "left").groupBy(
        F.coalesce("category", F.lit("Unlisted")).alias("category"), F.coalesce("recoverable", F.lit(False)).alias("recoverable"),
        F.coalesce("is_security", F.lit(False)).alias("is_security")).agg(F.sum("errors").alias("errors"))


def error_message(kind: Column, first: Column, second: Column) -> Column:
    """Message text per transfer error kind from its one or two fields."""
    out = F.lit(None).cast("string")
    for name, pattern in rules.TRANSFER_ERRORS.items():
        args = [first.cast("string"), second.cast("string")][:pattern.count("%s")]
        text = F.format_string(pattern, *args) if args else F.lit(pattern)
        out = F.when(kind == name, text).otherwise(out)
    return out


def gate(tasks: DataFrame, verdicts: DataFrame, key: str = "task_id") -> DataFrame:
    """Blocked when the header scan found a threat, Complete when clean, Failed without a header."""
    return tasks.join(verdicts.select(key, "verdict"), key, "left").withColumn(
        "status", F.when(F.col("verdict").isin("Malicious", "Suspicious"), "Blocked")
        .when(F.col("verdict") == "Clean", "Complete").otherwise("Failed"))


def history(gated: DataFrame, triage_bytes: int = rules.TRIAGE_BYTES) -> DataFrame:
    """Transfers and blocked threats per status, with the bytes blocking saved."""
    saved = F.when(F.col("status") == "Blocked", F.greatest(F.col("total_bytes") - triage_bytes, F.lit(0))).otherwise(0)
    return gated.groupBy("status").agg(
        F.count("*").alias("transfers"), F.sum("total_bytes").alias("bytes"), F.sum(saved).alias("bytes_saved"))


# ------------------------------------------------------------ windows

def speed_windows(df: DataFrame, millis: int, key: str = "task_id") -> DataFrame:
    """Bytes and KB/s per aligned window; works on batch and streaming input.

    Needs ``ts`` (TIMESTAMP) and ``chunk_bytes``.
    """
    w = F.window("ts", f"{millis} milliseconds")
    out = df.groupBy(key, w).agg(F.sum("chunk_bytes").alias("bytes"), F.count("*").alias("chunks"))
    return out.select(key, F.unix_micros("window.start").alias("window_us"), "bytes", "chunks",
                      F.floor(F.col("bytes") / (1024.0 * millis / 1000)).alias("speed_kbps"))


def progress_windows(df: DataFrame, millis: int = 250, key: str = "task_id") -> DataFrame:
    """At most one progress value per window: the latest."""
    w = F.window("ts", f"{millis} milliseconds")
    return df.groupBy(key, w).agg(F.max_by("progress", F.struct("ts", "event_id")).alias("progress")).select(
        key, F.unix_micros("window.start").alias("window_us"), "progress")
