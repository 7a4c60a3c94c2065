"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and is then timed three times into the `noop` sink, so every row is computed
and none reaches the driver; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "bin_quantity", "flag_returnflag", "flag_large_map", "duration_order_to_ship", "duration_text_dates", "compound_or",
    "compound_null_policies", "risk_order_tiers", "spec_apply_chain", "label_distribution", "quarantine_split",
    "findings_all", "verdicts", "coverage_partitions", "lineage_rows", "profile_orders", "profile_classify", "propose_all",
    "library_lint", "library_normalise", "suggest_fixes", "lineage_impact", "memory_upsert_first_wins", "memory_lookup",
    "review_with_memory", "replay_last_wins", "event_counters", "event_chain", "latest_status", "no_progress",
    "labels_fallback", "timestamp_labels", "triage_keywords", "csv_narrowed", "stream_apply_spec", "stream_ticket_timeout",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from rulefold.queries import QUERIES, load_all

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rulefold-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    names = sys.argv[1:] or HEADLINES
    times = {}
    for name in names:
        taken = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "total seconds of headline queries (median of 3 after warm-up)", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
