import random

import pytest
from pyspark.sql import functions as F

from bytesieve.functions import ordered as O
from bytesieve.functions import text as T
from bytesieve.operators import telemetry as te


@pytest.mark.parametrize("n,text", [(512, "512 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1792, "1.8 KB"), (1048576, "1.0 MB"),
                                    (1073741824, "1.0 GB"), (0, "0 B"), (1023, "1023 B")])
def test_size_text(spark, n, text):
    assert spark.range(1).select(T.size_text(F.lit(n).cast("long"))).first()[0] == text


@pytest.mark.parametrize("n,text", [(0, "Unknown"), (59, "00:59"), (61, "01:01"), (3661, "01:01:01"), (360000, "100:00:00")])
def test_eta_text(spark, n, text):
    assert spark.range(1).select(T.eta_text(F.lit(n).cast("long"))).first()[0] == text


def test_progress(spark):
    df = spark.createDataFrame([(1000, 500, 0), (0, 5, 10), (1048576, 524288, 256), (100, 200, 5)],
                               "total_bytes long, done_bytes long, speed_kbps long")
    assert [(r.progress, r.eta_secs) for r in te.with_progress(df).collect()] == [(.5, 0), (0.0, 0), (.5, 2), (2.0, 0)]
    assert [(r.percentage, r.eta_secs) for r in te.with_percentage(df).collect()] == [(50.0, 0), (0.0, 0), (50.0, 2), (200.0, 0)]


@pytest.mark.parametrize("ram,cpu,level", [(64.9, 59.9, 0), (65, 0, 1), (0, 60, 1), (80, 10, 2), (10, 80, 2), (95, 0, 3), (0, 95, 3)])
def test_levels(spark, ram, cpu, level):
    assert spark.range(1).select(te.resource_level(F.lit(float(ram)), F.lit(float(cpu)))).first()[0] == level


@pytest.mark.parametrize("header,name", [
    ('attachment; filename="video.mp4"', "video.mp4"), ("inline;  filename=a=b ", "a"), ("attachment", None),
    ("attachment; filename", None), (None, None)])
def test_disposition(spark, header, name):
    assert spark.range(1).select(te.disposition_filename(F.lit(header).cast("string"))).first()[0] == name


def test_resume(spark):
    saves = spark.createDataFrame([("a", 10, "e1", 100), ("a", 30, "e2", 200), ("b", 5, None, 150)],
                                  "output_path string, bytes_downloaded long, etag string, saved_at long")
    latest = te.latest_states(saves)
    assert {(r.output_path, r.bytes_downloaded) for r in latest.collect()} == {("a", 30), ("b", 5)}
    assert te.latest_states(saves, spark.createDataFrame([("a",)], "output_path string")).count() == 1
    disk = spark.createDataFrame([("a", 30), ("b", 6)], "output_path string, size long")
    got = {r.output_path: (r.offset, r.can_resume) for r in te.resume_offsets(latest, disk, 300).collect()}
    assert got == {"a": (30, True), "b": (0, False)}
    late = {r.output_path: r.offset for r in te.resume_offsets(latest, disk, 200 + 604800).collect()}
    assert late == {"a": 0, "b": 0}
    srv = spark.createDataFrame([("a", "e1"), ("b", "x"), ("c", "x")], "output_path string, etag string")
    assert {r.output_path: r.valid for r in te.validate_states(srv, latest).collect()} == {"a": False, "b": True, "c": False}


def test_retry(spark):
    rows = [(1, False)] * 4 + [(2, False), (2, True), (3, True)]
    got = {r.task_id: (r.retries, r.backoff_ms, r.exhausted) for r in te.retry_profile(
        spark.createDataFrame(rows, "task_id int, succeeded boolean")).collect()}
    assert got == {1: (3, 6000, True), 2: (1, 1000, False), 3: (0, 0, False)}


def hot_rows(n=4000):
    rng = random.Random(11)
    t, rows = 0, []
    for i in range(n):
        t += rng.choice([1, 50, 89, 90, 91, 4000]) * 1_000_000
        rows.append((rng.choice([1, 1, 1, 2, 3]), t, i, rng.randrange(4)))
    rng.shuffle(rows)
    return rows


def test_ordered_helpers_match_a_plain_loop(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "host int, ts_us long, event_id int, level int")
    sessions = {(r.host, r.start_us, r.end_us, r.requests) for r in te.idle_sessions(df, rows_per_bucket=40).collect()}
    changes = {(r.host, r.event_id, r.prev_level, r.level) for r in te.level_changes(df, rows_per_bucket=40).collect()}
    want_s, want_c = set(), set()
    for h in (1, 2, 3):
        cur, last = None, 0
        for _, t, i, lv in sorted((r for r in rows if r[0] == h), key=lambda r: (r[1], r[2])):
            if cur and t - cur[1] <= 90_000_000:
                cur = [cur[0], t, cur[2] + 1]
            else:
                if cur:
                    want_s.add((h, *cur))
                cur = [t, t, 1]
            if lv != last:
                want_c.add((h, i, last, lv))
            last = lv
        want_s.add((h, *cur))
    assert sessions == want_s and changes == want_c


def test_null_keys_and_orders_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 200_000_000, 6), (1, None, 7), (1, 3, 8)], "k int, t long, v int")
    prev = {r.v: r.prev_v for r in O.with_previous(df, "k", ["t"], ["v"]).collect()}
    assert prev == {5: None, 6: 5, 7: None, 8: 7}
    sums = {r.v: r.s for r in O.with_running_sum(df, ["k"], [F.col("t")], {"s": F.col("v")}, F.floor(F.col("t") / 10)).collect()}
    assert sums == {5: 5, 6: 11, 7: 7, 8: 15}
    plan = O.with_previous(df, "k", ["t"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_cut_tree(spark):
    cuts = [1.0, 2.0, 5.0]
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 2.0, 4.9, 5.0, 9.0)], "x double")
    assert [r[0] for r in df.select(O.cut_tree(F.col("x"), cuts)).collect()] == [0, 0, 1, 1, 2, 2, 3]
    assert df.select(O.cut_tree(F.col("x"), [])).first()[0] == 0


def test_timeline_and_cancel(spark):
    log = spark.createDataFrame([(1, 1, 10, "Queued", "a"), (2, 1, 20, "Downloading", "b"), (3, 1, 30, "Blocked", "c"),
                                 (4, 2, 5, "Failed", "d"), (5, 2, 6, "Downloading", "e")],
                                "event_id int, task_id int, ts_us long, status string, detail string")
    got = {r.task_id: r for r in te.status_timeline(log).collect()}
    assert (got[1].status, got[1].started_us, got[1].completed_us, got[1].scan_verdict) == ("Blocked", 20, 30, "c")
    assert (got[2].status, got[2].error) == ("Downloading", "d")
    out = te.cancel(te.status_timeline(log), spark.createDataFrame([(2,), (9,)], "task_id int"))
    assert {r.task_id: r.status for r in out.collect()} == {1: "Blocked", 2: "Cancelled"}


def test_errors(spark):
    one = lambda k, a, b: spark.range(1).select(te.error_message(F.lit(k), F.lit(a), F.lit(b))).first()[0]
    assert one("HttpError", 404, "gone") == "HTTP error: 404 - gone"
    assert one("InvalidResumeOffset", 9, 5) == "Resume failed: offset 9 exceeds file size 5"
    assert one("Cancelled", 1, 2) == "Download cancelled"


def test_density_buckets(spark):
    """A dense key is cut into buckets of about the rows asked for; a sparse one stays whole."""
    df = spark.range(20_000).select(F.lit("hot").alias("host"), F.col("id").alias("ts_us")).union(
        spark.range(10).select(F.lit("cold").alias("host"), (F.col("id") * 10**9).alias("ts_us")))
    per = O.with_density_bucket(df, "host", "ts_us", rows=1000).groupBy("host", "_bucket").count().collect()
    hot = [r["count"] for r in per if r.host == "hot"]
    assert len(hot) == 20 and max(hot) <= 1001
    assert [r["count"] for r in per if r.host == "cold"] == [10]


def test_lookup_with_hot_and_null_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None).cast("long")).when(F.col("id") % 3 == 1, 7)
                                  .otherwise(F.col("id")).alias("k"), "id")
    per = df.groupBy("k").agg(F.count("*").alias("n"))
    got = O.lookup(df, per, ["k"], ["id"])
    assert got.count() == 5000 and got.where("n > 1600").count() == 3334
