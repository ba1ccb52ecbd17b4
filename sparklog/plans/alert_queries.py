"""Alert and delivery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklog.operators import alerts as al
from sparklog.operators import delivery as de
from sparklog.plans.anomaly_queries import counter_table, detected
from sparklog.plans.oracle import AS_OF, ORDERS_AS_OF, sql
from sparklog.plans.registry import query
from sparklog.sources import tables as t

HISTORY = ('id, subscription_id, event_id, status, attempts, http_status, latency_ms, next_attempt_at, delivered_at, '
           'last_error, created_at')


def events(spark, d):
    return al.all_anomalies(*detected(counter_table(spark, d)))


def routed(spark, d):
    return al.route_alerts(events(spark, d))


def _wire(spark, d):
    """Both detectors as the JSON text they publish."""
    rate, found = detected(counter_table(spark, d))
    rate = rate.select(F.to_json(F.struct(
        "id", F.col("schema_version").alias("schemaVersion"), F.col("event_type").alias("eventType"),
        F.col("project_id").alias("projectId"), F.col("service_id").alias("serviceId"), "detector", "severity",
        F.col("deduplication_key").alias("deduplicationKey"), "description",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.struct(F.col("metrics.error_rate").alias("errorRate"), F.col("metrics.total_count").alias("totalCount"),
                 F.col("metrics.error_count").alias("errorCount")).alias("metrics"),
    )).alias("value"))
    volume = found.select(F.to_json(F.struct(
        F.col("schema_version").alias("schemaVersion"), F.col("event_type").alias("eventType"),
        F.col("event_id").alias("eventId"), F.col("project_id").alias("projectId"),
        F.col("service_id").alias("serviceId"), "detector", "severity",
        F.col("deduplication_key").alias("deduplicationKey"), F.unix_seconds("timestamp").alias("timestamp"),
        F.col("z_score").alias("zScore"), F.col("current_volume").alias("currentVolume"),
        F.col("mean_volume").alias("meanVolume"), F.col("std_dev").alias("stdDev"), "type",
    )).alias("value"))
    return rate.unionByName(volume)


@query("normalize_anomalies", sql("""
    SELECT event_id, project_id, service_id, detector, severity, deduplication_key, description, "timestamp",
      round(z_score, 6) AS z_score, type, error_rate, total_count FROM anom_events""", "anom_events"))
def normalized(spark, d):
    rows = al.normalize_anomalies(_wire(spark, d), "value", t.AS_OF)
    return rows.select(
        "event_id", "project_id", "service_id", "detector", "severity", "deduplication_key", "description", "timestamp",
        F.round("metrics.z_score", 6).alias("z_score"), "metrics.type", "metrics.error_rate", "metrics.total_count",
    )


@query("normalize_anomalies_strict", sql("""
    SELECT CASE WHEN detector = 'VOLUME_Z_SCORE' THEN event_id END AS event_id, deduplication_key,
      CASE WHEN detector = 'VOLUME_Z_SCORE' THEN description END AS description, detector = 'VOLUME_Z_SCORE' AS has_metrics
    FROM anom_events""", "anom_events"))
def normalized_strict(spark, d):
    rows = al.normalize_anomalies(_wire(spark, d), "value", t.AS_OF, strict=True)
    return rows.select("event_id", "deduplication_key", "description", F.col("metrics").isNotNull().alias("has_metrics"))


@query("route_alerts", sql("SELECT event_id, severity, detector FROM routed", "routed"))
def route_alerts(spark, d):
    return routed(spark, d).select("event_id", "severity", "detector")


@query("render_alerts", sql(r"""
    SELECT event_id, project_id, service_id, 'CRITICAL ALERT: Anomaly Detected in ' || service_id AS subject,
      concat_ws(chr(10), 'ATTENTION DEVOPS TEAM,', '', 'An anomaly has been detected in the production environment.', '', 'Details:',
        '- Service ID: ' || service_id, '- Severity: ' || severity, '- Detector: ' || detector, '- Project ID: ' || project_id,
        '- Detection Time: ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S'), '', 'Please investigate immediately.', '',
        '- Log Analytics', '') AS body FROM routed""", "routed"))
def render_alerts(spark, d):
    return al.render_alerts(routed(spark, d))


@query("event_payload", sql("""
    SELECT event_id, event_id AS payload_id, project_id, severity, strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ') AS "time",
      description, type, round(coalesce(z_score, error_rate), 6) AS measure FROM routed""", "routed"))
def event_payload(spark, d):
    rows = al.event_payload(routed(spark, d))

    def field(path):
        return F.get_json_object("payload", f"$.{path}")

    return rows.select(
        "event_id", field("eventId").alias("payload_id"), field("projectId").cast("bigint").alias("project_id"),
        field("severity").alias("severity"), field("timestamp").alias("time"), field("description").alias("description"),
        field("metrics.type").alias("type"),
        F.round(F.coalesce(field("metrics.zScore"), field("metrics.errorRate")).cast("double"), 6).alias("measure"),
    )


@query("fan_out", sql("SELECT event_id, project_id, subscription_id FROM fanned", "fanned"))
def fan_out(spark, d):
    return al.fan_out(routed(spark, d), t.subscriptions(spark, d)).select("event_id", "project_id", "subscription_id")


def _known(spark, d, rate):
    """Deliveries that exist already: those of the error-rate events."""
    rate = al.route_alerts(al.rate_events(rate))
    return al.fan_out(rate, t.subscriptions(spark, d)).select("subscription_id", "event_id")


@query("new_deliveries", sql(
    "SELECT subscription_id, event_id FROM fanned WHERE detector = 'VOLUME_Z_SCORE'", "fanned"))
def new_deliveries(spark, d):
    rate, volume = detected(counter_table(spark, d))
    fanned = al.fan_out(al.route_alerts(al.all_anomalies(rate, volume)), t.subscriptions(spark, d))
    twice = fanned.unionByName(fanned)
    return de.new_deliveries(twice, _known(spark, d, rate)).select("subscription_id", "event_id")


@query("enqueue_deliveries", sql(f"""
    SELECT sha256(CAST(to_json([CAST(subscription_id AS VARCHAR), event_id]) AS VARCHAR)) AS id, subscription_id, event_id,
      'PENDING' AS status, 0 AS attempts, {AS_OF} AS next_attempt_at, {AS_OF} AS created_at, event_id AS payload_event
    FROM fanned WHERE detector = 'VOLUME_Z_SCORE'""", "fanned"))
def enqueue_deliveries(spark, d):
    rate, volume = detected(counter_table(spark, d))
    routed = al.route_alerts(al.all_anomalies(rate, volume))
    rows = de.enqueue_deliveries(routed, t.subscriptions(spark, d), _known(spark, d, rate), t.AS_OF)
    return rows.select(
        "id", "subscription_id", "event_id", "status", "attempts", "next_attempt_at", "created_at",
        F.get_json_object("payload", "$.eventId").alias("payload_event"),
    )


def _pad(mask: int) -> str:
    high = "".join("0123456789ABCDEF"[i ^ (mask >> 4)] for i in range(16))
    low = "".join("0123456789ABCDEF"[i ^ (mask & 15)] for i in range(16))
    return f"""unhex(list_aggregate(list_transform(range(0, 64), lambda i:
        translate(substr(k, CAST(i * 2 + 1 AS BIGINT), 1), '0123456789ABCDEF', '{high}')
        || translate(substr(k, CAST(i * 2 + 2 AS BIGINT), 1), '0123456789ABCDEF', '{low}')), 'string_agg', ''))"""


@query("sign_payloads", sql(f"""
    SELECT d.id, 'sha256=' || sha256(p.o || unhex(sha256(p.i || encode(d.payload)))) AS signature
    FROM deliveries d JOIN (SELECT id, {_pad(0x36)} AS i, {_pad(0x5C)} AS o FROM (
      SELECT id, rpad(CASE WHEN length(secret) > 64 THEN upper(sha256(secret)) ELSE hex(encode(secret)) END, 128, '0') AS k FROM subs)) p
      ON p.id = d.subscription_id""", "deliveries", "subs"))
def sign_payloads(spark, d):
    return al.sign_payloads(t.deliveries(spark, d), t.subscriptions(spark, d)).select("id", "signature")


# --- deliveries -----------------------------------------------------------------------------------------

@query("due_deliveries", sql(f"""
    SELECT id, status, next_attempt_at, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY status ORDER BY next_attempt_at, id) AS rank FROM deliveries
      WHERE status IN ('PENDING', 'RETRY_PENDING') AND next_attempt_at <= {ORDERS_AS_OF}) WHERE rank <= 100""", "deliveries"))
def due_deliveries(spark, d):
    rows = de.due_deliveries(t.deliveries(spark, d), t.ORDERS_AS_OF)
    return rows.select("id", "status", "next_attempt_at", F.col("rank").cast("bigint").alias("rank"))


_APPLIED = """(
    SELECT d.id, d.subscription_id, d.event_id, d.payload, d.created_at,
      CASE WHEN NOT tried THEN d.status WHEN ok THEN 'DELIVERED' WHEN NOT retry OR d.attempts >= 4 THEN 'FAILED' ELSE 'RETRY_PENDING' END AS status,
      CASE WHEN tried THEN d.attempts + 1 ELSE d.attempts END AS attempts,
      CASE WHEN tried THEN http ELSE d.http_status END AS http_status,
      CASE WHEN tried THEN lat ELSE d.latency_ms END AS latency_ms,
      CASE WHEN tried AND retry AND d.attempts < 4 THEN fin + to_seconds(CASE d.attempts WHEN 0 THEN 30 WHEN 1 THEN 120 WHEN 2 THEN 600 ELSE 1800 END)
           ELSE d.next_attempt_at END AS next_attempt_at,
      CASE WHEN tried AND NOT (retry AND d.attempts < 4) THEN fin ELSE d.delivered_at END AS delivered_at,
      CASE WHEN NOT tried THEN d.last_error WHEN ok THEN NULL WHEN http IS NULL THEN err
           WHEN retry THEN 'HTTP ' || http || ': ' || body ELSE 'Non-retryable HTTP ' || http || ': ' || body END AS last_error,
      tried AND retry AND d.attempts >= 4 AS dead
    FROM (SELECT d.*, o.delivery_id IS NOT NULL AS tried, o.http_status AS http, o.error AS err, o.latency_ms AS lat, o.body, o.finished_at AS fin,
            coalesce(o.http_status BETWEEN 200 AND 299, false) AS ok,
            o.http_status IS NULL OR o.http_status IN (408, 429) OR o.http_status >= 500 AS retry
          FROM deliveries d LEFT JOIN outcomes o ON o.delivery_id = d.id) d)"""


def applied(spark, d):
    return de.apply_attempts(t.deliveries(spark, d), t.outcomes(spark, d))


@query("apply_attempts", sql(f"""
    SELECT id, status, attempts, http_status, latency_ms, next_attempt_at, delivered_at, last_error, dead FROM {_APPLIED}""",
    "deliveries", "outcomes"))
def apply_attempts(spark, d):
    return applied(spark, d).select(
        "id", "status", "attempts", "http_status", "latency_ms", "next_attempt_at", "delivered_at", "last_error", "dead"
    )


def _repeated(spark, d):
    """The outcomes, a second later one of every tried delivery, and one of every delivery that does not wait."""
    tried = t.table(spark, d, "orders").where("o_orderstatus = 'F' or o_orderpriority <> '5-LOW'")
    late = tried.select(
        F.col("o_orderkey").cast("string").alias("delivery_id"), F.lit(500).alias("http_status"),
        F.lit(None).cast("string").alias("error"), F.lit(1).cast("long").alias("latency_ms"), F.lit("late").alias("body"),
        F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, 2, 0, 0)").alias("finished_at"),
    )
    return t.outcomes(spark, d).unionByName(late)


@query("apply_attempts_repeated", sql(f"""
    SELECT id, status, attempts, http_status, latency_ms, next_attempt_at, delivered_at, last_error, dead FROM {_APPLIED}""",
    "deliveries", "outcomes"))
def apply_attempts_repeated(spark, d):
    return de.apply_attempts(t.deliveries(spark, d), _repeated(spark, d)).select(
        "id", "status", "attempts", "http_status", "latency_ms", "next_attempt_at", "delivered_at", "last_error", "dead"
    )


@query("ignored_outcomes", sql("""
    SELECT CAST(o_orderkey AS VARCHAR) AS delivery_id, CAST(1 AS BIGINT) AS ignored,
      CASE WHEN o_orderstatus = 'F' THEN 'not waiting' ELSE 'repeated' END AS reason
    FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority <> '5-LOW'"""))
def ignored_outcomes(spark, d):
    return de.ignored_outcomes(t.deliveries(spark, d), _repeated(spark, d))


@query("dead_letters", sql(f"""
    SELECT id, subscription_id, event_id, payload, attempts, http_status AS last_http_status, last_error,
      delivered_at AS failed_at, created_at AS original_created_at FROM {_APPLIED} WHERE dead""", "deliveries", "outcomes"))
def dead_letters(spark, d):
    return de.dead_letters(applied(spark, d))


def _requests(spark, d):
    """Replay requests for every urgent order, by the project of a third of the subscriptions."""
    urgent = t.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return urgent.select(F.col("o_orderkey").cast("string").alias("delivery_id"),
                         F.expr("o_custkey % 3 + 1").alias("project_id"))


_ASKED = """(SELECT a.delivery_id, a.project_id, d.* EXCLUDE (id), d.id AS id FROM (
      SELECT CAST(o_orderkey AS VARCHAR) AS delivery_id, o_custkey % 3 + 1 AS project_id FROM orders WHERE o_orderpriority = '1-URGENT') a
    LEFT JOIN (SELECT d.*, s.project_id AS owner FROM deliveries d JOIN subs s ON s.id = d.subscription_id) d
      ON d.id = a.delivery_id AND d.owner = a.project_id)"""


@query("replay_deliveries", sql(f"""
    SELECT id, subscription_id, 'PENDING' AS status, 0 AS attempts, {ORDERS_AS_OF} AS next_attempt_at,
      CAST(NULL AS VARCHAR) AS last_error, http_status FROM {_ASKED} WHERE status <> 'DELIVERED'""", "deliveries", "subs"))
def replay_deliveries(spark, d):
    updated, _ = de.replay_deliveries(t.deliveries(spark, d), t.subscriptions(spark, d), _requests(spark, d), t.ORDERS_AS_OF)
    return updated.select("id", "subscription_id", "status", "attempts", "next_attempt_at", "last_error", "http_status")


@query("replay_refused", sql(f"""
    SELECT delivery_id, project_id, CASE WHEN status IS NULL THEN 'Delivery not found or access denied'
      ELSE 'Cannot replay already delivered webhook' END AS reason
    FROM {_ASKED} WHERE status IS NULL OR status = 'DELIVERED'""", "deliveries", "subs"))
def replay_refused(spark, d):
    return de.replay_deliveries(t.deliveries(spark, d), t.subscriptions(spark, d), _requests(spark, d), t.ORDERS_AS_OF)[1]


@query("delivery_history", sql(f"SELECT {HISTORY} FROM deliveries WHERE subscription_id = 7", "deliveries"))
def delivery_history(spark, d):
    return de.delivery_history(t.deliveries(spark, d), 7, t.subscriptions(spark, d), project_id=3)


@query("project_deliveries", sql("""
    SELECT d.id, d.event_id, d.status, s.project_id FROM deliveries d JOIN subs s ON s.id = d.subscription_id
    WHERE s.project_id = 2""", "deliveries", "subs"))
def project_deliveries(spark, d):
    rows = de.project_deliveries(t.deliveries(spark, d), t.subscriptions(spark, d), 2)
    return rows.select("id", "event_id", "status", "project_id")


@query("dlq_history", sql("SELECT * FROM dlq WHERE subscription_id = 7", "dlq"))
def dlq_history(spark, d):
    return de.dlq_history(t.dlq(spark, d), 7)


@query("dlq_since", sql("SELECT id, failed_at FROM dlq WHERE failed_at > TIMESTAMP '1999-01-01 00:00:00'", "dlq"))
def dlq_since(spark, d):
    return de.dlq_since(t.dlq(spark, d), "1999-01-01T00:00:00").select("id", "failed_at")


@query("active_subscriptions", sql(
    "SELECT id, project_id, url, active, created_at, updated_at FROM subs WHERE project_id = 2 AND active", "subs"))
def active_subscriptions(spark, d):
    return de.active_subscriptions(t.subscriptions(spark, d), 2)


@query("delivery_stats", sql("""
    SELECT metric, label, CAST(sum(n) AS BIGINT) AS count,
      CASE WHEN metric = 'delivery' THEN CAST(sum(ms) AS DOUBLE) / sum(timed) END AS latency_mean_ms,
      CASE WHEN metric = 'delivery' THEN max(top) END AS latency_max_ms
    FROM (SELECT 'delivery' AS metric, CASE WHEN status = 'DELIVERED' THEN 'success' ELSE 'failure' END AS label, count(*) AS n,
            sum(latency_ms) AS ms, count(latency_ms) AS timed, max(latency_ms) AS top FROM done GROUP BY ALL
          UNION ALL SELECT 'attempt', CAST(attempts AS VARCHAR), count(*), 0, 0, 0 FROM done GROUP BY ALL
          UNION ALL SELECT 'http_status', CAST(http_status AS VARCHAR), count(*), 0, 0, 0 FROM done WHERE http_status IS NOT NULL GROUP BY ALL
          UNION ALL SELECT 'dlq', CAST(subscription_id AS VARCHAR), count(*), 0, 0, 0 FROM dlq GROUP BY ALL)
    GROUP BY metric, label""", "done"))
def delivery_stats(spark, d):
    return de.delivery_stats(t.deliveries(spark, d), t.dlq(spark, d))
