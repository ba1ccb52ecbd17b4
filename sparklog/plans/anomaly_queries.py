"""Detector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog import constants as C
from sparklog.operators import alerts as al
from sparklog.operators import anomaly as an
from sparklog.operators import search as se
from sparklog.operators.metrics import counters, counts_of, minute_counts
from sparklog.plans.oracle import AS_OF, sql
from sparklog.plans.registry import query
from sparklog.session import scratch_dir
from sparklog.sources import tables as t

HOURLY = {"width": "1 hour", "lookback": "7 days", "min_drop_mean": 1.0}
SPIKE = 15
AT = "2024-01-22T04:30:00"

RATE_COLUMNS = ["project_id", "service_id", "severity", "deduplication_key", "description", "timestamp", "id",
                "error_rate", "total_count", "error_count"]
VOLUME_COLUMNS = ["project_id", "service_id", "severity", "deduplication_key", "event_id", "timestamp", "z_score",
                  "current_volume", "mean_volume", "std_dev", "type"]


def counter_table(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counters of the logs, stored: the only read of the events for everything that is rolled up from them."""
    path, counted = scratch_dir(spark, "counters"), counters(t.logs(spark, d), "1 hour")
    counted.write.parquet(path)
    return spark.read.schema(counted.schema).parquet(path)


def detected(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Error-rate anomalies by day and volume anomalies by hour, from counters."""
    rate = an.error_rate_anomalies(an.windows_of(counted, "1 day"), spike=SPIKE)
    return rate, an.volume_anomalies_backfill(counts_of(counted, "1 hour"), t.AS_OF, **HOURLY)


def rate_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return an.error_rate_anomalies(an.error_rate_windows(t.logs(spark, d), "1 day"), spike=SPIKE)


def hour_counts(spark: SparkSession, d: str) -> DataFrame:
    return minute_counts(t.logs(spark, d), "1 hour")


def volume_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return an.volume_anomalies_backfill(hour_counts(spark, d), t.AS_OF, **HOURLY)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def rate_view(df: DataFrame) -> DataFrame:
    return df.select("*", "metrics.error_rate", "metrics.total_count", "metrics.error_count").select(*RATE_COLUMNS)


def volume_view(df: DataFrame) -> DataFrame:
    return rounded(df.select(*VOLUME_COLUMNS), "z_score", "mean_volume", "std_dev")


VOLUME_SELECT = """project_id, service_id, severity, deduplication_key, event_id, "timestamp", round(z_score, 6) AS z_score,
  current_volume, round(mean_volume, 6) AS mean_volume, round(std_dev, 6) AS std_dev, type"""


@query("error_rate_anomalies_daily", sql(
    'SELECT project_id, service_id, severity, deduplication_key, description, "timestamp", id, error_rate, total_count, error_count FROM rate_anoms',
    "rate_anoms"))
def error_rate_anomalies_daily(spark, d):
    return rate_view(rate_anomalies(spark, d))


@query("error_rate_windows_hourly", sql("""
    SELECT project_id, service_id, bucket AS window_start, bucket + INTERVAL 1 HOUR AS window_end, total AS total_count,
      error AS error_count, warn AS warning_count, error / CAST(total AS DOUBLE) AS error_rate FROM hour_counts""", "hour_counts"))
def error_rate_windows_hourly(spark, d):
    return an.error_rate_windows(t.logs(spark, d), "1 hour")


@query("error_rate_windows_by_service", sql("""
    SELECT max_by(project_id, "timestamp") AS project_id, service_id, date_trunc('day', "timestamp") AS window_start,
      date_trunc('day', "timestamp") + INTERVAL 1 DAY AS window_end, count(*) AS total_count,
      count(*) FILTER (level IN ('ERROR', 'FATAL')) AS error_count, count(*) FILTER (level = 'WARN') AS warning_count,
      count(*) FILTER (level IN ('ERROR', 'FATAL')) / CAST(count(*) AS DOUBLE) AS error_rate
    FROM logs GROUP BY service_id, date_trunc('day', "timestamp")""", "logs"))
def windows_by_service(spark, d):
    return an.error_rate_windows(t.logs(spark, d), "1 day", keys=("service_id",))


@query("volume_baseline", sql("""
    SELECT project_id, service_id, count(*) AS points, round(CAST(sum(total) AS DOUBLE) / count(*), 6) AS mean_volume,
      round(sqrt(CAST(count(*) * sum(total * total) - sum(total) * sum(total) AS DOUBLE)) / count(*), 6) AS std_dev
    FROM hour_counts WHERE bucket BETWEEN TIMESTAMP '2024-01-15 03:00:00' AND TIMESTAMP '2024-01-22 03:00:00' GROUP BY ALL""",
    "hour_counts"))
def volume_baseline(spark, d):
    stats = an.volume_baseline(hour_counts(spark, d), AT, "1 hour", "7 days")
    return rounded(stats, "mean_volume", "std_dev")


@query("volume_anomalies", sql(
    f"SELECT {VOLUME_SELECT} FROM vol_anoms WHERE \"timestamp\" = TIMESTAMP '2024-01-22 03:00:00'", "vol_anoms"))
def volume_anomalies_now(spark, d):
    return volume_view(an.volume_anomalies(hour_counts(spark, d), AT, **HOURLY))


@query("volume_anomalies_backfill", sql(f"SELECT {VOLUME_SELECT} FROM vol_anoms", "vol_anoms"))
def volume_backfill(spark, d):
    return volume_view(volume_anomalies(spark, d))


@query("all_anomalies", sql("""
    SELECT event_id, project_id, service_id, detector, severity, deduplication_key, description, "timestamp",
      round(z_score, 6) AS z_score, type, error_rate, total_count FROM anom_events""", "anom_events"))
def all_anomalies(spark, d):
    events = al.all_anomalies(*detected(counter_table(spark, d)))
    return events.select(
        "event_id", "project_id", "service_id", "detector", "severity", "deduplication_key", "description", "timestamp",
        F.round("metrics.z_score", 6).alias("z_score"), "metrics.type", "metrics.error_rate", "metrics.total_count",
    )


@query("dedup_anomalies", sql("""
    SELECT deduplication_key, "timestamp", id AS event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY deduplication_key ORDER BY "timestamp", id) AS rn FROM (
        SELECT id, "timestamp", project_id || ':' || service_id || ':volume:' || strftime("timestamp", '%Y-%m-%dT%H:00:00Z') AS deduplication_key FROM logs))
    WHERE rn = 1""", "logs"))
def dedup_anomalies(spark, d):
    """Every log row as a candidate of its hour: many repeats per key."""
    key = F.concat_ws(":", "project_id", "service_id", F.lit("volume"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:00:00'Z'"))
    rows = t.logs(spark, d).select(F.col("id").alias("event_id"), "timestamp", key.alias("deduplication_key"))
    return an.dedup_anomalies(rows)


@query("dedup_anomalies_window", sql("""
    SELECT deduplication_key, "timestamp", (SELECT min(id) FROM logs l WHERE l."timestamp" = k."timestamp"
      AND l.project_id || ':' || l.service_id = k.deduplication_key) AS event_id FROM (
      WITH RECURSIVE l AS (SELECT project_id || ':' || service_id AS deduplication_key, "timestamp" FROM logs),
      k AS (SELECT deduplication_key, min("timestamp") AS "timestamp" FROM l GROUP BY 1
        UNION ALL SELECT k.deduplication_key, min(l."timestamp") FROM k JOIN l ON l.deduplication_key = k.deduplication_key
          AND l."timestamp" >= k."timestamp" + INTERVAL 24 HOUR GROUP BY k.deduplication_key)
      SELECT * FROM k) k""", "logs"))
def dedup_anomalies_window(spark, d):
    """Every log row as a candidate of its service: a kept one silences the service for a day."""
    key = F.concat_ws(":", "project_id", "service_id")
    rows = t.logs(spark, d).select(F.col("id").alias("event_id"), "timestamp", key.alias("deduplication_key"))
    return an.dedup_anomalies(rows, "24 hours")


@query("recent_anomalies", sql(f"""
    SELECT project_id, service_id, deduplication_key, "timestamp", rank FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "timestamp" DESC, id) AS rank
      FROM rate_anoms WHERE "timestamp" >= {AS_OF} - INTERVAL 30 DAY) WHERE rank <= 50""", "rate_anoms"))
def recent_anomalies(spark, d):
    rows = an.recent_anomalies(rate_anomalies(spark, d), t.AS_OF, n=50, days=30)
    return rows.select("project_id", "service_id", "deduplication_key", "timestamp", F.col("rank").cast("bigint").alias("rank"))


_WORDING = """CASE WHEN type = 'SPIKE' THEN 'Massive Spike' ELSE 'Silent Failure (Drop)' END"""
ANOMALY_LOGS = f"""SELECT 'anomaly-' || strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ') || '-' || service_id AS id, service_id,
  'ANOMALY' AS level, project_id, 'ML System Insight: ' || {_WORDING} || ' detected in log volume. Z-Score: '
    || format('{{:.2f}}', z_score) || '. (Volume: ' || current_volume || ', Normal: ~' || CAST(round(mean_volume) AS BIGINT) || ')' AS message,
  "timestamp" FROM vol_anoms"""


@query("anomalies_as_logs", sql(ANOMALY_LOGS, "vol_anoms"))
def anomalies_as_logs(spark, d):
    return se.anomalies_as_logs(volume_anomalies(spark, d))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("diagnose_anomalies", sql("""
    SELECT event_id, CASE WHEN type = 'DROP' THEN 'Service "' || service_id || '" has completely stopped emitting logs. The expected baseline is ~'
        || CAST(round(mean_volume) AS BIGINT) || ' logs/min, but the current volume dropped to ' || current_volume
        || '. This indicates the service may have crashed, lost network connectivity, or its container was terminated unexpectedly.'
      ELSE 'Service "' || service_id || '" is emitting an abnormally high volume of logs. The expected baseline is ~'
        || CAST(round(mean_volume) AS BIGINT) || ' logs/min, but the current volume spiked to ' || current_volume
        || '. This could indicate an infinite retry loop, a cascading failure, a DDoS attack, or a severe bug generating excessive logging.' END AS root_cause,
      replace(CASE WHEN type = 'DROP' THEN @DROP@ ELSE @SPIKE@ END, '{s}', service_id) AS suggested_fix
    FROM vol_anoms""".replace("@DROP@", _literal(C.DROP_FIX)).replace("@SPIKE@", _literal(C.SPIKE_FIX)), "vol_anoms"))
def diagnose_anomalies(spark, d):
    rows = se.diagnose_anomalies(volume_anomalies(spark, d))
    return rows.select("event_id", "root_cause", "suggested_fix")
