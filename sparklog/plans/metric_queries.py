"""Counter and custom-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklog.operators import metrics as met
from sparklog.operators import retention
from sparklog.operators.alerts import url_policy
from sparklog.plans.oracle import AS_OF, sql
from sparklog.plans.registry import query
from sparklog.sources import tables as t

_WEEK = f"bucket >= {AS_OF} - INTERVAL 168 HOUR"


@query("minute_counts", sql("SELECT * FROM minute_counts", "minute_counts"))
def minute_counts(spark, d):
    return met.minute_counts(t.logs(spark, d))


@query("dashboard_metrics", sql(f"""
    SELECT project_id, service_id, CAST(sum(total) AS BIGINT) AS total_logs, CAST(sum(error) AS BIGINT) AS error_count,
      CAST(sum(warn) AS BIGINT) AS warning_count, sum(error) / CAST(sum(total) AS DOUBLE) AS error_rate
    FROM minute_counts WHERE bucket >= {AS_OF} - INTERVAL 25 HOUR GROUP BY ALL""", "minute_counts"))
def dashboard(spark, d):
    return met.dashboard_metrics(met.minute_counts(t.logs(spark, d)), t.AS_OF)


@query("error_timeline", sql(f"""
    SELECT project_id, service_id, strftime(bucket, '%Y-%m-%dT%H:%M') AS bucket, error AS error_count
    FROM minute_counts WHERE {_WEEK}""", "minute_counts"))
def timeline(spark, d):
    return met.error_timeline(met.minute_counts(t.logs(spark, d)), t.AS_OF, hours=168)


@query("error_timeline_maps", sql(f"""
    SELECT project_id, service_id, string_agg(strftime(bucket, '%Y-%m-%dT%H:%M') || '=' || error, ' ' ORDER BY bucket) AS timeline
    FROM hour_counts WHERE {_WEEK} GROUP BY ALL""", "hour_counts"))
def timeline_maps(spark, d):
    maps = met.error_timeline_maps(met.minute_counts(t.logs(spark, d), "1 hour"), t.AS_OF, hours=168)
    entries = F.transform(F.map_entries("timeline"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.select("project_id", "service_id", F.array_join(entries, " ").alias("timeline"))


@query("volume_at", sql("""
    SELECT k.project_id, k.service_id, coalesce(c.total, 0) AS volume
    FROM (SELECT DISTINCT project_id, service_id FROM hour_counts) k
    LEFT JOIN hour_counts c ON c.project_id = k.project_id AND c.service_id = k.service_id
      AND c.bucket = TIMESTAMP '2024-01-20 08:00:00'""", "hour_counts"))
def volume_at(spark, d):
    counts = met.minute_counts(t.logs(spark, d), "1 hour")
    keys = counts.select("project_id", "service_id").distinct()
    return met.volume_at(counts, keys, "2024-01-20T08:00:00")


_OK_DEFS = r"SELECT * FROM metric_defs WHERE trim(name) <> '' AND trim(regex_pattern) <> '' AND regex_pattern <> '(['"
_MATCHES = f"""(SELECT l.id, l.project_id, m.id AS metric_id, l."timestamp" FROM logs l JOIN ({_OK_DEFS}) m
    ON m.project_id = l.project_id AND regexp_full_match(l.message, m.regex_pattern))"""


@query("metric_defs_ok", sql(f"SELECT id, project_id, regex_pattern FROM ({_OK_DEFS})", "metric_defs"))
def defs_ok(spark, d):
    return met.validate_metric_defs(t.custom_metrics(spark, d))[0].select("id", "project_id", "regex_pattern")


@query("metric_defs_rejected", sql("""
    SELECT id, CASE WHEN trim(name) = '' THEN 'Name and regexPattern are required'
      ELSE 'Invalid Java regular expression. Example: .*MOCK EMAIL SENT.*' END AS reason
    FROM metric_defs WHERE trim(name) = '' OR regex_pattern = '(['""", "metric_defs"))
def defs_rejected(spark, d):
    return met.validate_metric_defs(t.custom_metrics(spark, d))[1].select("id", "reason")


@query("match_metrics", sql(f"SELECT id, project_id, metric_id FROM {_MATCHES}", "logs", "metric_defs"))
def matches(spark, d):
    return met.match_metrics(t.logs(spark, d), t.custom_metrics(spark, d)).select("id", "project_id", "metric_id")


@query("match_metrics_join", sql(f"SELECT id, project_id, metric_id FROM {_MATCHES}", "logs", "metric_defs"))
def matches_join(spark, d):
    """The plan for more definitions than a broadcast may hold."""
    rows = met.match_metrics(t.logs(spark, d), t.custom_metrics(spark, d), max_rows=0)
    return rows.select("id", "project_id", "metric_id")


# The same conditions in plain string functions: a regular expression per pair would take minutes here.
_MANY = """(SELECT * FROM logs l JOIN (SELECT range AS n, range % 3 + 1 AS project FROM range(3000)) m ON m.project = l.project_id AND CASE n % 6
    WHEN 0 THEN contains(l.message, '"k": ' || n // 6 || ',') OR contains(l.message, '"k": ' || n // 6 || '}')
    WHEN 1 THEN contains(l.message, 'session-' || n)
    WHEN 2 THEN CASE WHEN ends_with(rtrim(l.message, '}'), n::VARCHAR) THEN regexp_full_match(l.message, '[a-z]+ .*k.*: ?' || n || '\\}?') ELSE false END
    WHEN 3 THEN length(l.message) BETWEEN 1 AND n % 90 + 10 AND NOT contains(l.message, chr(10))
    WHEN 4 THEN CASE WHEN contains(l.message, ' ' || n) THEN regexp_full_match(l.message, '.*(click|view).* ' || n || '.*') ELSE false END
    ELSE CASE WHEN starts_with(l.message, 'user') THEN regexp_full_match(l.message, 'user[^ ]* ' || n // 6 || '.*') ELSE false END END)"""


@query("match_many_metrics", sql(f"SELECT n AS metric_id, count(*) AS hits, min(id) AS first_id FROM {_MANY} GROUP BY ALL", "logs"))
def many_metrics(spark, d):
    """1,000 definitions a project, of which some require no text."""
    pattern = F.expr("""case id % 6 when 0 then concat('.*"k": ', id div 6, '[,}].*') when 1 then concat('(?s).*session-', id, '.*')
        when 2 then concat('[a-z]+ .*k.*: ?', id, '\\\\}?') when 3 then concat('.{1,', id % 90 + 10, '}')
        when 4 then concat('.*(click|view).* ', id, '.*') else concat('user[^ ]* ', id div 6, '.*') end""")
    defs = spark.range(3000).select(
        "id", (F.col("id") % 3 + 1).alias("project_id"), F.lit("m").alias("name"), pattern.alias("regex_pattern"),
        F.lit("2023-12-01").cast("timestamp_ntz").alias("created_at"))
    return met.match_metrics(t.logs(spark, d), defs).groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("hits"), F.min("id").alias("first_id"))


_METRIC_HOURS = f"""(SELECT project_id, metric_id, time_bucket(INTERVAL 1 HOUR, "timestamp") AS bucket, count(*) AS count
    FROM {_MATCHES} GROUP BY ALL)"""


@query("metric_counts", sql(f"SELECT * FROM {_METRIC_HOURS}", "logs", "metric_defs"))
def metric_counts(spark, d):
    return met.metric_counts(t.logs(spark, d), t.custom_metrics(spark, d), "1 hour")


@query("metric_series", sql(f"""
    SELECT m.project_id, m.id AS metric_id, b.bucket, coalesce(c.count, 0) AS count
    FROM metric_defs m, (SELECT unnest(generate_series({AS_OF} - INTERVAL 179 HOUR, {AS_OF}, INTERVAL 1 HOUR)) AS bucket) b
    LEFT JOIN {_METRIC_HOURS} c ON c.project_id = m.project_id AND c.metric_id = m.id AND c.bucket = b.bucket""",
    "logs", "metric_defs"))
def metric_series(spark, d):
    defs = t.custom_metrics(spark, d)
    counts = met.metric_counts(t.logs(spark, d), defs, "1 hour")
    return met.metric_series(counts, defs, t.AS_OF, points=180, width="1 hour")


@query("apply_retention", sql(f'SELECT id, "timestamp" FROM logs WHERE "timestamp" >= {AS_OF} - INTERVAL 7 DAY', "logs"))
def retained(spark, d):
    return retention.apply_retention(t.logs(spark, d), t.AS_OF).select("id", "timestamp")


@query("expire_counts", sql(f"SELECT * FROM minute_counts WHERE bucket >= {AS_OF} - INTERVAL 25 HOUR", "minute_counts"))
def expired(spark, d):
    return retention.expire(met.minute_counts(t.logs(spark, d)), "bucket", t.AS_OF, "25 hours")


_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"


@query("url_policy_pages", f"""
    SELECT page_id, {_HOST} = '' OR lower(split_part(url, ':', 1)) NOT IN ('http', 'https') AS refused,
      CASE WHEN lower(split_part(url, ':', 1)) NOT IN ('http', 'https') THEN 'Only HTTP/HTTPS URLs are allowed'
           WHEN {_HOST} = '' THEN 'URL must have a host' END AS error FROM pages""")
def pages_policy(spark, d):
    checked = url_policy(t.table(spark, d, "pages"), "url")
    return checked.select("page_id", (~F.col("is_valid")).alias("refused"), "error")


_VARIANT_URL = """CASE page_id % 10
    WHEN 0 THEN url WHEN 1 THEN 'ftp://x.example/' || page_id WHEN 2 THEN '  ' WHEN 3 THEN 'nope'
    WHEN 4 THEN 'http://localhost/' || page_id WHEN 5 THEN 'http://10.1.2.' || (page_id % 256) || '/'
    WHEN 6 THEN 'http://172.' || (page_id % 40) || '.0.1/' WHEN 7 THEN 'http://[::1]/' || page_id
    WHEN 8 THEN 'http://bad host/' ELSE 'http://169.254.169.254/latest' END"""


@query("url_policy_variants", f"""
    SELECT page_id, CASE page_id % 10 WHEN 1 THEN 'Only HTTP/HTTPS URLs are allowed' WHEN 2 THEN 'URL is required'
      WHEN 3 THEN 'Only HTTP/HTTPS URLs are allowed' WHEN 4 THEN 'Host is not allowed'
      WHEN 5 THEN 'Resolved IP is in blocked range: 10.1.2.' || (page_id % 256)
      WHEN 6 THEN CASE WHEN page_id % 40 BETWEEN 16 AND 31 THEN 'Resolved IP is in blocked range: 172.' || (page_id % 40) || '.0.1' END
      WHEN 7 THEN 'Resolved IP is in blocked range: ::1' WHEN 8 THEN 'Invalid URL format'
      WHEN 9 THEN 'Resolved IP is in blocked range: 169.254.169.254' END AS error FROM pages""")
def variants_policy(spark, d):
    pages = t.table(spark, d, "pages").withColumn("url", F.expr(_VARIANT_URL))
    return url_policy(pages, "url").select("page_id", "error")


@query("url_policy_resolved", f"""
    SELECT page_id, CASE WHEN {_HOST} LIKE 'blog.%' THEN 'Resolved IP is in blocked range: 10.0.0.7'
      WHEN {_HOST} LIKE 'm.%' THEN 'Unable to resolve host: ' || {_HOST} END AS error FROM pages""")
def resolved_policy(spark, d):
    """Looked-up addresses as a table: blogs resolve to a private one, mobile hosts do not resolve."""
    pages = t.table(spark, d, "pages")
    hosts = pages.select(F.try_parse_url("url", F.lit("HOST")).alias("host")).where("host not like 'm.%'").distinct()
    resolved = hosts.withColumn("ip", F.expr("case when host like 'blog.%' then '10.0.0.7' else '93.184.216.34' end"))
    return url_policy(pages, "url", resolved).select("page_id", "error")
