"""Wall time of the headline queries, one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_ALL=1`` runs every registered
query. Each query runs once to warm up, then twice, and the faster time counts; its whole result is computed
and thrown away.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sparklog.plans import queries

HEADLINES = (
    "error_rate_anomalies_daily", "error_rate_windows_hourly", "minute_counts", "dashboard_metrics",
    "volume_anomalies_backfill", "parse_logs", "ingest_logs", "redact_pii_documents", "redact_pii_pages",
    "search_logs_keyword", "search_documents_token", "trace_groups", "trace_preview", "annotate_logs",
    "match_metrics", "metric_counts", "all_anomalies", "fan_out", "enqueue_deliveries", "apply_attempts",
    "due_deliveries", "sign_payloads", "delivery_stats", "url_policy_pages", "stream_error_rate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    registered = queries()
    names = list(registered) if os.environ.get("BENCH_ALL") else HEADLINES
    seconds = {}
    for name in names:
        times = []
        for _ in range(3):
            begin = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(min(times[1:]), 3)
    print(json.dumps({
        "metric": "headline queries, warm", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
