"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from bytesieve import session
from bytesieve.plans import catalog

HEADLINE = [
    "detect_type", "triage_verdict", "header_issues", "verdict_rollup", "type_census", "url_clean",
    "feat_full", "feat_entropy", "byte_profile_by_class",
    "val_report", "val_duplicates", "split_stratified", "augment", "balance_oversample",
    "filter_segment", "filter_segment_ts", "ts_pid_census", "ts_repair", "clean_stream_hls", "segment_reassembly",
    "playlist_entries", "best_variant",
    "auc_roc", "roc_curve", "class_report", "softmax_predict", "latency_stats",
    "task_progress", "retry_profile", "host_pool_stats", "idle_sessions", "level_changes", "gate_then_fetch",
    "st_speed_1s", "st_reassembly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false", "bytesieve.input.partitions": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.queries()
    known["detect_type"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
