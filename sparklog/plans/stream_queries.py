"""Streaming queries: each runs the stream over the test table to its end and returns the stored result.

Counters, metrics, detectors and ingest get the events in PARTS, in time order; after each part the job is started again from its
checkpoint. ``stream_error_rate`` (a bench query) and ``stream_dedup`` read them in one go. The check SQL is that of the batch
operator: on the same rows both must agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparklog import schemas
from sparklog.operators.alerts import normalize_anomalies
from sparklog.operators.anomaly import error_rate_anomalies, windows_of
from sparklog.operators.metrics import validate_metric_defs
from sparklog.plans.anomaly_queries import HOURLY, SPIKE, VOLUME_SELECT, rate_view, volume_anomalies, volume_view
from sparklog.plans.alert_queries import _wire
from sparklog.plans.metric_queries import _METRIC_HOURS
from sparklog.plans.oracle import AS_OF, redacted, sql
from sparklog.plans.registry import query
from sparklog.session import scratch_dir
from sparklog.sources import tables as t
from sparklog.sources.readers import stream_anomalies, stream_logs
from sparklog.sources.sinks import keyed_logs, read_documents
from sparklog.streaming import jobs

EVENTS = schemas.table(
    event_id="long", ts="timestamp_ntz", user_id="long", event_type="string", value="double", props="string"
)


PARTS = 3


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    return stream_logs(spark, d, EVENTS, pathGlobFilter="events*.parquet")


def finish(stream: StreamingQuery, seconds: int = 3600) -> None:
    """Wait for a query that ends with its input."""
    if not stream.awaitTermination(seconds):
        stream.stop()
        raise TimeoutError("the stream did not end")


def in_parts(spark: SparkSession, d: str, root: str, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Hands the events over in time order, part by part; each time ``run`` goes on with all that has come since its last end."""
    events, at = t.table(spark, d, "events"), F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(at, [i / PARTS for i in range(1, PARTS)])).first()[0] or []
    part = sum((F.coalesce((at > cut).cast("int"), F.lit(0)) for cut in cuts), F.lit(0))
    for i in range(PARTS):
        events.where(part == i).write.mode("append").parquet(f"{root}/in")
        finish(run(stream_logs(spark, f"{root}/in", EVENTS)))


@query("stream_error_rate", sql(
    'SELECT project_id, service_id, severity, deduplication_key, description, "timestamp", id, error_rate, total_count, error_count FROM rate_anoms',
    "rate_anoms"))
def stream_error_rate(spark, d):
    root = scratch_dir(spark, "error-rate")
    finish(jobs.run_error_rate(t.logs_of(event_stream(spark, d)), f"{root}/out", f"{root}/cp", "1 day"))
    return rate_view(error_rate_anomalies(jobs.error_rate_state(spark, f"{root}/out"), spike=SPIKE))


@query("stream_minute_counts", sql("SELECT * FROM minute_counts", "minute_counts"))
def stream_minute_counts(spark, d):
    root = scratch_dir(spark, "minute-counts")
    in_parts(spark, d, root, lambda events: jobs.run_minute_counts(t.logs_of(events), f"{root}/out", f"{root}/cp"))
    return jobs.read_counts(spark, f"{root}/out")


@query("stream_metric_counts", sql(f"SELECT * FROM {_METRIC_HOURS}", "logs", "metric_defs"))
def stream_metric_counts(spark, d):
    root = scratch_dir(spark, "metric-counts")
    in_parts(spark, d, root, lambda events: jobs.run_metric_counts(
        t.logs_of(events), lambda: validate_metric_defs(t.custom_metrics(spark, d))[0], f"{root}/out", f"{root}/cp", "1 hour"))
    return jobs.read_metric_counts(spark, f"{root}/out")


@query("stream_volume_detector", sql(
    f"SELECT {VOLUME_SELECT} FROM vol_anoms WHERE \"timestamp\" < (SELECT max(bucket) FROM hour_counts)",
    "vol_anoms", "hour_counts"))
def stream_volume_detector(spark, d):
    root = scratch_dir(spark, "volume")
    in_parts(spark, d, root, lambda events: jobs.run_volume_detector(
        t.logs_of(events), f"{root}/counts", f"{root}/out", f"{root}/cp", every=None, **HOURLY))
    return volume_view(jobs.read_volume_anomalies(spark, f"{root}/out"))


@query("stream_volume_ticks", sql(
    f"SELECT {VOLUME_SELECT} FROM vol_anoms WHERE \"timestamp\" < (SELECT max(bucket) FROM hour_counts)",
    "vol_anoms", "hour_counts"))
def stream_volume_ticks(spark, d):
    """The detector as keyed state with timers, moved by the watermark."""
    root = scratch_dir(spark, "ticks")
    in_parts(spark, d, root, lambda events: jobs.run_volume_ticks(
        t.logs_of(events), f"{root}/out", f"{root}/cp", clock="event", every=None, **HOURLY))
    return volume_view(jobs.read_volume_anomalies(spark, f"{root}/out"))


@query("stream_dedup", sql("""
    SELECT min("timestamp") AS first_seen, deduplication_key FROM (
      SELECT "timestamp", project_id || ':' || service_id || ':' || strftime("timestamp", '%Y-%m-%d') AS deduplication_key FROM logs)
    GROUP BY deduplication_key""", "logs"))
def stream_dedup(spark, d):
    """Log rows as repeats of a daily key; the rows of the one source file arrive in time order."""
    root = scratch_dir(spark, "dedup")
    key = F.concat_ws(":", "project_id", "service_id", F.date_format("timestamp", "yyyy-MM-dd"))
    rows = t.logs_of(event_stream(spark, d)).select("timestamp", key.alias("deduplication_key"))
    writer = jobs.stream_dedup(rows).writeStream.format("parquet").option("checkpointLocation", f"{root}/cp")
    finish(writer.option("path", f"{root}/out").trigger(availableNow=True).start())
    kept = spark.read.schema("timestamp timestamp, deduplication_key string").parquet(f"{root}/out")
    return kept.select(F.col("timestamp").alias("first_seen"), "deduplication_key")


@query("stream_recent_anomalies", sql("""
    SELECT event_id, project_id, service_id, "timestamp" FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "timestamp" DESC, event_id) AS rank FROM vol_anoms
      WHERE "timestamp" >= (SELECT max("timestamp") FROM vol_anoms) - INTERVAL 21 DAY) WHERE rank <= 20""", "vol_anoms"))
def stream_recent_anomalies(spark, d):
    root = scratch_dir(spark, "recent")
    found = volume_anomalies(spark, d)
    found.write.parquet(f"{root}/in")
    rows = spark.readStream.schema(found.schema).parquet(f"{root}/in")
    finish(jobs.run_recent_anomalies(rows, f"{root}/out", f"{root}/cp", n=20, days=21))
    return jobs.read_recent_anomalies(spark, f"{root}/out").select("event_id", "project_id", "service_id", "timestamp")


@query("stream_recent_list", sql("""
    SELECT event_id, project_id, service_id, "timestamp", round(z_score, 6) AS z_score FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "timestamp" DESC, event_id) AS rank FROM vol_anoms
      WHERE "timestamp" >= (SELECT max("timestamp") FROM vol_anoms) - INTERVAL 21 DAY) WHERE rank <= 20""", "vol_anoms"))
def stream_recent_list(spark, d):
    """The lists as keyed state; what is older than 21 days leaves by its timer."""
    root = scratch_dir(spark, "recent-list")
    found = volume_anomalies(spark, d)
    found.write.parquet(f"{root}/in")
    rows = spark.readStream.schema(found.schema).parquet(f"{root}/in")
    finish(jobs.run_recent_list(rows, f"{root}/out", f"{root}/cp", n=20, days=21, clock="event"))
    return jobs.read_recent_list(spark, f"{root}/out").select(
        "event_id", "project_id", "service_id", "timestamp", F.round("z_score", 6).alias("z_score"))


@query("stream_alerts", sql(f"""
    SELECT sha256(CAST(to_json([CAST(subscription_id AS VARCHAR), event_id]) AS VARCHAR)) AS id, subscription_id, event_id,
      'PENDING' AS status, {AS_OF} AS next_attempt_at FROM fanned""", "fanned"))
def stream_alerts(spark, d):
    root = scratch_dir(spark, "alerts")
    _wire(spark, d).write.text(f"{root}/in")
    finish(jobs.run_alerts(
        stream_anomalies(spark, f"{root}/in"), lambda: t.subscriptions(spark, d), f"{root}/out", f"{root}/cp", t.AS_OF
    ))
    return jobs.read_deliveries(spark, f"{root}/out").select("id", "subscription_id", "event_id", "status", "next_attempt_at")


@query("stream_index", sql(
    'SELECT id, service_id, level, project_id, message, "timestamp", trace_id, span_id FROM logs', "logs"))
def stream_index(spark, d):
    """Four micro-batches whose files hold times of the whole range, so most rows come late."""
    root = scratch_dir(spark, "index")
    t.table(spark, d, "events").repartition(4, F.hash("event_id")).write.parquet(f"{root}/in")
    events = stream_logs(spark, f"{root}/in", EVENTS, maxFilesPerTrigger=1)
    finish(jobs.run_index(t.logs_of(events), f"{root}/out", f"{root}/cp"))
    return read_documents(spark, f"{root}/out").select(
        "id", "service_id", "level", F.col("project_id").cast("bigint").alias("project_id"), "message", "timestamp",
        "trace_id", "span_id",
    )


def _topic(spark, d):
    """Published log events with broken lines among them, as four text files and micro-batches."""
    root, logs = scratch_dir(spark, "topic"), t.logs(spark, d)
    broken = logs.where("cast(id as bigint) % 97 = 3").select(F.concat(F.lit('{"broken '), "id").alias("value"))
    keyed_logs(logs).select("value").unionByName(broken).repartition(4, F.hash("value")).write.text(f"{root}/in")
    finish(jobs.run_topic(
        stream_anomalies(spark, f"{root}/in", maxFilesPerTrigger=1), f"{root}/out", f"{root}/cp", "1 day", t.AS_OF, spike=SPIKE))
    return jobs.topic_stores(spark, f"{root}/out")


@query("stream_topic_events", sql(
    'SELECT id, service_id, level, project_id, message, "timestamp", trace_id, span_id FROM logs', "logs"))
def stream_topic_events(spark, d):
    return _topic(spark, d)["events"].read().select(
        "id", "service_id", "level", "project_id", "message", "timestamp", "trace_id", "span_id")


@query("stream_topic_bad", sql("""
    SELECT 'unknown' AS id, 'Failed to parse log message: {"broken ' || id AS message FROM logs WHERE CAST(id AS BIGINT) % 97 = 3""", "logs"))
def stream_topic_bad(spark, d):
    return _topic(spark, d)["bad"].read().select("id", "message")


@query("stream_topic_anomalies", sql("SELECT service_id AS key, id, severity, total_count, error_count FROM rate_anoms", "rate_anoms"))
def stream_topic_anomalies(spark, d):
    """Of all published changes, those that tell the end of a window that is anomalous in the end."""
    stores = _topic(spark, d)
    sent = normalize_anomalies(stores["published"].read(), "value", t.AS_OF).select(
        F.col("service_id").alias("key"), F.col("event_id").alias("id"), "severity", "metrics.total_count", "metrics.error_count").distinct()
    final = error_rate_anomalies(windows_of(stores["counters"].read(), "1 day"), spike=SPIKE)
    return sent.join(final.select("id", "severity", "metrics.total_count", "metrics.error_count"), ["id", "severity", "total_count", "error_count"], "left_semi")


def _ingested(spark, d):
    root = scratch_dir(spark, "ingest")
    in_parts(spark, d, root, lambda events: jobs.run_ingest(
        t.raw_logs_of(events), lambda: t.projects(spark, d), f"{root}/out", f"{root}/cp", t.AS_OF))
    return jobs.read_ingested(spark, f"{root}/out")


@query("stream_ingest", sql(f"""
    SELECT id, "timestamp", service_id, level, {redacted('message')} AS message, tenant AS project_id, trace_id, span_id
    FROM entries WHERE tenant IS NOT NULL""", "entries"))
def stream_ingest(spark, d):
    logs, _ = _ingested(spark, d)
    return logs.select("id", "timestamp", "service_id", "level", "message", "project_id", "trace_id", "span_id")


@query("stream_ingest_errors", sql(
    "SELECT record_id AS id FROM classified WHERE NOT valid OR tenant IS NULL", "classified"))
def stream_ingest_errors(spark, d):
    return _ingested(spark, d)[1].select("id")
