"""State operators with timers against the batch operators, and what a wall clock reports when all records stop."""

from __future__ import annotations

import datetime as dt
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparklog import schemas
from sparklog.operators import anomaly as an
from sparklog.operators import metrics as met
from sparklog.plans.stream_queries import finish
from sparklog.streaming import jobs, state

LOGS = schemas.table(timestamp="timestamp", project_id="long", service_id="string", level="string")
START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
RULES = {"width": "1 minute", "lookback": "20 minutes"}


def same(left, right, columns):
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def volumes():
    """(minute, project, service, records): steady, a silence longer than the look-back, a return, a spike, a null project and service."""
    for m in range(120):
        yield m, 1, "steady", 8 + m % 3
        yield m, None, None, 6
        if m < 30 or m > 80:
            yield m, 1, "pause", 9 + m % 2
        yield m, 2, "spiky", 60 if m == 25 else 5 + m % 2
        if m % 7 == 0:
            yield m, 2, "rare", 1


def test_event_clock_equals_the_backfill_over_restarts(spark, tmp_path):
    folder, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = [(m, (START + dt.timedelta(minutes=m, seconds=i % 60), p, s, "INFO")) for m, p, s, n in volumes() for i in range(n)]
    for lo, hi in ((0, 27), (27, 28), (28, 100), (100, 120)):
        stream = put(spark, [r for m, r in rows if lo <= m < hi], LOGS, folder)
        finish(jobs.run_volume_ticks(stream, out, cp, clock="event", every=None, delay="2 minutes", **RULES), 120)
    logs = spark.createDataFrame([r for _, r in rows], LOGS)
    counts, got = met.minute_counts(logs), jobs.read_volume_anomalies(spark, out)
    # The watermark stands two minutes before the newest record.
    want = an.volume_anomalies_backfill(counts, START + dt.timedelta(minutes=117), **RULES)
    assert same(want, got, ["deduplication_key", "timestamp", "severity", "current_volume", "mean_volume", "type"])
    kinds = {(r.service_id, r.type) for r in got.collect()}
    assert {("spiky", "SPIKE"), ("pause", "DROP")} <= kinds


def test_a_total_silence_is_reported_by_the_wall_clock(spark, tmp_path):
    folder, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    now = dt.datetime.now(dt.timezone.utc).replace(microsecond=0)
    rows = [(now - dt.timedelta(seconds=s), 1, "s", "INFO") for s in range(40) for _ in range(10 + s % 2)]
    stream = put(spark, rows, LOGS, folder)
    running = jobs.run_volume_ticks(stream, out, cp, "1 second", "2 minutes", every="1 second")
    try:
        for _ in range(90):
            found = [r for r in jobs.read_volume_anomalies(spark, out).collect() if r.type == "DROP" and r.current_volume == 0]
            if found:
                break
            time.sleep(1)
    finally:
        running.stop()
    assert found and found[0].service_id == "s"


def test_records_are_counted_before_they_meet():
    seen = pa.array([START] * 5, pa.timestamp("us", "UTC"))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 1, 1, 2, 2]), pa.array(["a", "a", None, "a", "a"]), pa.array([60, 60, 60, 60, 120]), seen],
        ["project_id", "service_id", "tick", "seen_at"])
    rows = [r for b in state._partial_counts(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert sorted((r["project_id"], r["service_id"] or "", r["tick"], r["n"]) for r in rows) == [
        (1, "", 60, 1), (1, "a", 60, 2), (2, "a", 60, 1), (2, "a", 120, 1)]


def anomalies(hours, project=lambda i: i % 2):
    return [(1, "ANOMALY_DETECTED", f"e{i:03d}", project(i), "s", "d", "HIGH", f"k{i}", START + dt.timedelta(hours=h, microseconds=i), 4.0, 1,
             1.0, 1.0, "SPIKE") for i, h in hours]


def listed(spark, tmp_path, parts, **options):
    folder, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in parts:
        stream = put(spark, part, schemas.VOLUME_ANOMALY, folder)
        finish(jobs.run_recent_list(stream, out, cp, clock="event", **options), 120)
    return jobs.read_recent_list(spark, out)


@pytest.mark.parametrize("n", [5, 200])
def test_recent_list_equals_the_batch_ranking(spark, tmp_path, n):
    """Equal times, an event that is sent again, a project that stops, and a jump that expires all that was listed."""
    parts = [anomalies([(i, i) for i in range(40)]), anomalies([(i, i // 2 * 2) for i in range(39, 90)], lambda i: 1),
             anomalies([(i, 24 * 7 + i) for i in range(90, 110)], lambda i: None if i % 5 == 0 else i % 2)]
    got = listed(spark, tmp_path, parts, n=n, days=7, delay="2 hours")
    rows = {r[2]: r for part in parts for r in part if r[2] != "e039" or r in parts[0]}
    newest = START + dt.timedelta(hours=24 * 7 + 109 - 2)
    again = [r for r in parts[1] if r[2] == "e039"]
    table = spark.createDataFrame([*rows.values(), *again], schemas.VOLUME_ANOMALY)
    want = an.recent_anomalies(table, newest, n, 7).drop("rank")
    assert same(want, got, want.columns) and got.count() > 3


def test_what_has_no_time_or_id_is_not_listed(spark, tmp_path):
    rows = [list(r) for r in anomalies([(0, 0), (1, 1), (2, 2)], lambda i: 1)]
    rows[0][8], rows[1][2] = None, None
    assert [r.event_id for r in listed(spark, tmp_path, [[tuple(r) for r in rows]]).collect()] == ["e002"]
