"""Transfer-telemetry queries over tasks, saves, requests and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytesieve import rules
from bytesieve.operators import telemetry as te
from bytesieve.functions import text as T
from bytesieve.plans import duck as D
from bytesieve.plans.evaluation_queries import rounded
from bytesieve.plans.registry import query
from bytesieve.plans.tables import cte, given, pick, table
from bytesieve.plans.triage_queries import _VERDICT, verdicts

TASKS = cte("tasks")
NOW = 1_000_000


def tasks(spark, sf) -> DataFrame:
    return table(spark, sf, "tasks")


@query("task_progress", TASKS + """ select task_id, round(case when total_bytes > 0 then done_bytes / total_bytes::double else 0 end, 6) as progress,
  case when speed_kbps > 0 and total_bytes > done_bytes then floor((total_bytes - done_bytes) / 1024.0::double / speed_kbps)::bigint else 0 end as eta_secs
  from tasks""")
def task_progress(spark, sf):
    return rounded(te.with_progress(tasks(spark, sf)).select("task_id", "progress", "eta_secs"))


@query("percent_eta", TASKS + """, p as (select task_id, case when total_bytes > 0 then done_bytes / total_bytes::double * 100 else 0 end as percentage,
    case when total_bytes > 0 and speed_kbps > 0 then floor(greatest(total_bytes - done_bytes, 0) / 1024.0::double / speed_kbps)::bigint else 0 end as eta_secs
  from tasks)
  select task_id, round(percentage, 6) as percentage, eta_secs, case when eta_secs = 0 then 'Unknown'
    when eta_secs >= 3600 then printf('%02d:%02d:%02d', eta_secs // 3600, eta_secs % 3600 // 60, eta_secs % 60)
    else printf('%02d:%02d', eta_secs // 60, eta_secs % 60) end as eta_text from p""")
def percent_eta(spark, sf):
    return rounded(te.with_percentage(tasks(spark, sf)).select("task_id", "percentage", "eta_secs", "eta_text"))


@query("task_duration_speed", TASKS + """ select task_id, (completed_us - started_us) // 1000000 as duration_secs,
  case when (completed_us - started_us) // 1000000 > 0 then done_bytes // ((completed_us - started_us) // 1000000 * 1024) else 0 end as average_kbps
  from tasks""")
def task_duration_speed(spark, sf):
    return te.with_duration(tasks(spark, sf)).select("task_id", "duration_secs", "average_kbps")


@query("size_text", TASKS + """ select task_id, case when total_bytes >= 1073741824 then concat(printf('%.1f', total_bytes / 1073741824.0::double), ' GB')
  when total_bytes >= 1048576 then concat(printf('%.1f', total_bytes / 1048576.0::double), ' MB')
  when total_bytes >= 1024 then concat(printf('%.1f', total_bytes / 1024.0::double), ' KB') else concat(total_bytes, ' B') end as total_text from tasks""")
def size_text(spark, sf):
    return tasks(spark, sf).select("task_id", T.size_text(F.col("total_bytes")).alias("total_text"))


@query("status_flags", TASKS + f""", {D.STATUS_DIM} select task_id, tasks.status, is_terminal, is_active, description
  from tasks join status_dim d on tasks.status = d.status""")
def status_flags(spark, sf):
    return te.with_status_facts(tasks(spark, sf)).select("task_id", "status", "is_terminal", "is_active", "description")


_LOG = cte("transfers") + """, log as (select event_id, task_id, ts_us, case when value > 450 then 'Blocked'
    when event_type = 'signup' then 'Queued' when event_type = 'view' then 'Downloading' when event_type = 'click' then 'Scanning'
    when event_type = 'purchase' then 'Complete' else 'Failed' end as status, concat('d', event_id) as detail from transfers)
"""


def as_log(transfers: DataFrame) -> DataFrame:
    e = F.col("event_type")
    return transfers.select(
        "event_id", "task_id", "ts_us",
        F.when(F.col("value") > 450, "Blocked").when(e == "signup", "Queued").when(e == "view", "Downloading")
        .when(e == "click", "Scanning").when(e == "purchase", "Complete").otherwise("Failed").alias("status"),
        F.concat(F.lit("d"), "event_id").alias("detail"))


@query("status_timeline", _LOG + """ select task_id, arg_max(status, (ts_us, event_id)) as status,
  max(ts_us) filter (status = 'Downloading') as started_us, max(ts_us) filter (status in ('Complete', 'Failed', 'Blocked')) as completed_us,
  arg_max(detail, ts_us) filter (status = 'Failed') as error, arg_max(detail, ts_us) filter (status = 'Blocked') as scan_verdict,
  count(*) as changes from log group by 1""")
def status_timeline(spark, sf):
    return te.status_timeline(as_log(table(spark, sf, "transfers")))


@query("active_tasks", TASKS + f""", {D.STATUS_DIM}, c as (select task_id, case when task_id in (select c_custkey from customer where c_acctbal < 0)
    then 'Cancelled' else status end as status from tasks)
  select task_id, c.status, is_active from c join status_dim d on c.status = d.status""")
def active_tasks(spark, sf):
    """Tasks after a cancel list was applied."""
    ids = given(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("task_id"))
    return te.with_status_facts(te.cancel(tasks(spark, sf), ids)).select("task_id", "status", "is_active")


@query("progress_lookup", TASKS + """ select p_partkey * 10 as task_id,
  round(coalesce(case when total_bytes > 0 then done_bytes / total_bytes::double else 0 end, 0), 6) as progress
  from part left join tasks on p_partkey * 10 = task_id""")
def progress_lookup(spark, sf):
    """Progress of asked ids, unknown ones included."""
    ids = given(spark, sf, "part").select((F.col("p_partkey") * 10).alias("task_id"))
    return rounded(te.progress_of(ids, te.with_progress(tasks(spark, sf))))


SRV = cte("server")


@query("resumable", SRV + """ select output_path, coalesce(accept_ranges = 'bytes', false) and content_length is not null as resumable from server""")
def resumable(spark, sf):
    return table(spark, sf, "server").select(
        "output_path", te.resumable(F.col("accept_ranges"), F.col("content_length")).alias("resumable"))


@query("disposition_filename", SRV + """ select output_path, trim(trim(string_split(list_filter(string_split(disposition, ';'),
  lambda s: starts_with(trim(s), 'filename'))[1], '=')[2]), '"') as filename from server""")
def disposition_filename(spark, sf):
    return table(spark, sf, "server").select("output_path", te.disposition_filename(F.col("disposition")).alias("filename"))


_ST = cte("resume_saves", "server") + """, st as (select output_path, arg_max(url, saved_at) as url, arg_max(bytes_downloaded, saved_at) as bytes_downloaded,
    arg_max(total_size, saved_at) as total_size, max(saved_at) as saved_at, first(etag) as etag from resume_saves group by 1)
"""


def states(spark, sf):
    return te.latest_states(table(spark, sf, "resume_saves"))


@query("resume_upsert", _ST + """ select output_path, bytes_downloaded, saved_at from st
  where output_path not in (select output_path from server where http_status = 404)""")
def resume_upsert(spark, sf):
    """Last save per path; paths the server no longer has are cleared."""
    gone = table(spark, sf, "server").where("http_status = 404")
    return te.latest_states(table(spark, sf, "resume_saves"), gone).select("output_path", "bytes_downloaded", "saved_at")


@query("resumable_count", _ST + " select count(*) as states from st")
def resumable_count(spark, sf):
    return states(spark, sf).agg(F.count("*").alias("states"))


@query("resume_offsets", _ST + f""", l as (select output_path, max(bytes_downloaded) as size from resume_saves group by 1),
  o as (select st.output_path, case when greatest({NOW} - saved_at, 0) < 604800 and size = bytes_downloaded then bytes_downloaded else 0 end as "offset"
    from st left join l using (output_path))
  select output_path, "offset", "offset" > 0 as can_resume from o""")
def resume_offsets(spark, sf):
    """Disk sizes here: the largest position ever saved per path."""
    listing = table(spark, sf, "resume_saves").groupBy("output_path").agg(F.max("bytes_downloaded").alias("size"))
    return te.resume_offsets(states(spark, sf), listing, NOW).select("output_path", "offset", "can_resume")


@query("resume_progress", _ST + """ select st.output_path, round(case when total_size = 0 then 0 else bytes_downloaded / total_size::double * 100 end, 6) as progress_pct,
  st.url = server.url as matches_url from st join server using (output_path)""")
def resume_progress(spark, sf):
    srv = table(spark, sf, "server").select("output_path", F.col("url").alias("server_url"))
    return rounded(states(spark, sf).join(srv, "output_path").select(
        "output_path", te.resume_progress(F.col("bytes_downloaded"), F.col("total_size")).alias("progress_pct"),
        (F.col("url") == F.col("server_url")).alias("matches_url")))


@query("resume_validate", _ST + """ select server.output_path, st.output_path is not null and coalesce(st.etag = server.etag, true) as valid
  from server left join st using (output_path)""")
def resume_validate(spark, sf):
    return te.validate_states(table(spark, sf, "server"), states(spark, sf)).select("output_path", "valid")


@query("retry_profile", """with a as (select l_orderkey as task_id, count(*) as attempts, count(*) filter (l_returnflag = 'R') as failures from lineitem group by 1)
  select task_id, attempts, failures, least(failures, 3) as retries, (1000 * least(failures, 3) * (least(failures, 3) + 1) // 2)::bigint as backoff_ms,
    failures > 3 as exhausted from a""")
def retry_profile(spark, sf):
    log = given(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), (F.col("l_returnflag") != "R").alias("succeeded"))
    return te.retry_profile(log)


REQ = cte("requests") + """, r as (select *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) as host from requests)
"""


@query("host_pool_stats", REQ + """ select host, count(*) as total_requests, count(*) filter (hit) as cache_hits, count(*) filter (not hit) as cache_misses,
  count(*) filter (in_use) as active, count(*) filter (not in_use) as idle, round(count(*) filter (hit) / count(*)::double * 100, 6) as hit_rate from r group by 1""")
def host_pool_stats(spark, sf):
    return rounded(te.pool_stats(table(spark, sf, "requests")))


def _sessions_sql(secs: int) -> str:
    return REQ + f""", g as (select host, ts_us, event_id, case when ts_us - lag(ts_us) over w <= {secs * 1000000}::bigint then 0 else 1 end as new
      from r window w as (partition by host order by ts_us, event_id)),
    n as (select *, sum(new) over (partition by host order by ts_us, event_id rows unbounded preceding)::bigint as session from g)
    select host, session, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as requests from n group by 1, 2"""


def by_host(spark, sf):
    return table(spark, sf, "requests").withColumn("host", te.host_of(F.col("url")))


@query("idle_sessions", _sessions_sql(90))
def idle_sessions(spark, sf):
    return te.idle_sessions(by_host(spark, sf))


@query("idle_sessions_2h", _sessions_sql(7200))
def idle_sessions_2h(spark, sf):
    return te.idle_sessions(by_host(spark, sf), idle_secs=7200)


LVL = cte("sys_metrics") + f""", {D.LEVEL_DIM},
  m as (select *, greatest(case when ram_pct >= 95 then 3 when ram_pct >= 80 then 2 when ram_pct >= 65 then 1 else 0 end,
      case when cpu_pct >= 95 then 3 when cpu_pct >= 80 then 2 when cpu_pct >= 60 then 1 else 0 end)::int as level from sys_metrics)
"""


def metrics(spark, sf):
    return te.with_level(table(spark, sf, "sys_metrics"))


@query("resource_level", LVL + """ select event_id, m.level, level_name, speed_multiplier::double as speed_multiplier, max_concurrent, level_text
  from m join level_dim d on m.level = d.level""")
def resource_level(spark, sf):
    return te.with_level_facts(metrics(spark, sf)).select(
        "event_id", "level", "level_name", "speed_multiplier", "max_concurrent", "level_text")


_CHANGES = LVL + """, p as (select *, coalesce(lag(level) over (partition by host order by ts_us, event_id), 0) as prev_level from m)
  select host, ts_us, event_id, prev_level, level from p where level <> prev_level"""


@query("level_changes", _CHANGES)
def level_changes(spark, sf):
    return te.level_changes(metrics(spark, sf)).select("host", "ts_us", "event_id", "prev_level", "level")


@query("memory_stats", LVL + """ select host, round(avg(used_bytes / total_bytes::double * 100), 6) as mean_ram_pct, max(used_bytes // 1048576) as peak_used_mb,
  max(total_bytes // 1048576) as total_mb, min(greatest(total_bytes // 1048576 - used_bytes // 1048576, 0)) as least_free_mb,
  round(avg(cpu_pct), 6) as mean_cpu_pct, count(*) filter (used_bytes / total_bytes::double * 100 >= 95) as critical_samples from m group by 1""")
def memory_stats(spark, sf):
    return rounded(te.memory_stats(metrics(spark, sf)))


_KINDS = [k[0] for k in rules.ERROR_KINDS]


@query("error_taxonomy", f"""with e as (select {pick([*_KINDS, 'Gremlin'], 'event_id % 14', 'duck')} as error_kind from events),
  {D.values(rules.ERROR_KINDS, 'error_kind, category, recoverable, is_security', 'd')}
  select coalesce(category, 'Unlisted') as category, coalesce(recoverable, false) as recoverable,
    coalesce(is_security, false) as is_security, count(*) as errors from e left join d using (error_kind) group by 1, 2, 3""")
def error_taxonomy(spark, sf):
    e = given(spark, sf, "events").select(F.expr(pick([*_KINDS, "Gremlin"], "event_id % 14", "spark")).alias("error_kind"))
    return te.error_taxonomy(e)


_TRANSFER = list(rules.TRANSFER_ERRORS)
_MSG = " ".join(
    f"when {D.q(k)} then " + {0: D.q(p), 1: f"concat({D.q(p.split('%s')[0])}, a, {D.q(p.split('%s')[-1])})",
                              2: f"concat({D.q(p.split('%s')[0])}, a, {D.q((p.split('%s') + [''])[1])}, b)"}[p.count("%s")]
    for k, p in rules.TRANSFER_ERRORS.items())


@query("download_errors", f"""with e as (select event_id, {pick(_TRANSFER, 'event_id % 9', 'duck')} as kind,
    400 + event_id % 200 as a, event_type as b from events)
  select event_id, kind, case kind {_MSG} end as message from e""")
def download_errors(spark, sf):
    e = given(spark, sf, "events").select(
        "event_id", F.expr(pick(_TRANSFER, "event_id % 9", "spark")).alias("kind"),
        (400 + F.col("event_id") % 200).alias("a"), F.col("event_type").alias("b"))
    return e.select("event_id", "kind", te.error_message(F.col("kind"), F.col("a"), F.col("b")).alias("message"))


_GATE = _VERDICT + """, """ + TASKS[len("with "):] + """,
  g as (select task_id, total_bytes, case when verdict in ('Malicious', 'Suspicious') then 'Blocked' when verdict = 'Clean' then 'Complete' else 'Failed' end as status
    from tasks left join v on task_id = file_id)
"""


def gated(spark, sf):
    v = verdicts(spark, sf).select(F.col("file_id").alias("task_id"), "verdict")
    return te.gate(tasks(spark, sf).select("task_id", "total_bytes"), v)


@query("gate_then_fetch", _GATE + " select task_id, status from g")
def gate_then_fetch(spark, sf):
    return gated(spark, sf).select("task_id", "status")


@query("download_history", _GATE + """ select status, count(*) as transfers, sum(total_bytes)::bigint as bytes,
  sum(case when status = 'Blocked' then greatest(total_bytes - 102400, 0) else 0 end)::bigint as bytes_saved from g group by 1""")
def download_history(spark, sf):
    return te.history(gated(spark, sf))
