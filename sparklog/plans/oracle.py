"""Shared parts of the check SQL (DuckDB): the adapter tables, written a second time in plain SQL."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
ORDERS_AS_OF = "TIMESTAMP '2001-08-01 12:00:00'"

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "logs": ((), r"""
        SELECT CAST(event_id AS VARCHAR) AS id, ts AS "timestamp", 'svc-' || (user_id % 5) AS service_id,
          CASE WHEN event_type = 'error' AND value > 4 * (user_id % 5) AND value <= 30 + 10 * (user_id % 5)
                    AND user_id % 5 < 3 THEN 'ERROR'
               WHEN event_type = 'error' AND value > 40 * (user_id % 5) THEN 'FATAL'
               WHEN event_type IN ('error', 'view') AND value > 20 THEN 'WARN'
               WHEN event_type = 'click' THEN 'DEBUG' ELSE 'INFO' END AS level,
          CASE event_type
            WHEN 'error' THEN CASE event_id % 5
               WHEN 0 THEN 'Database connection refused for u' || user_id || '@example.com from 10.0.' || (user_id % 256) || '.' || (event_id % 256)
               WHEN 1 THEN 'java.lang.OutOfMemoryError: Java heap space' || chr(10) || chr(9) || 'at org.springframework.Worker.run(Worker.java:' || (event_id % 500) || ')'
               WHEN 2 THEN 'NullPointerException at step ' || (event_id % 97) || chr(10) || chr(9) || 'at app.Main'
               WHEN 3 THEN 'Timeout waiting for firewall handshake'
               ELSE 'payment failed with card 4111 1111 1111 ' || (1000 + event_id % 9000) END
            WHEN 'view' THEN 'High latency   detected ==== on page ' || (event_id % 40) || ' (' || CAST(floor(value) AS BIGINT) || 'ms), ' || repeat('slow ', event_id % 30)
            WHEN 'signup' THEN 'userid ' || user_id || ' request for login'
            WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'userid ' || user_id || ' request for login, order A' || event_id || ' created'
                                      ELSE 'order A' || event_id || ' created' END
            ELSE 'clicked with props ' || props END AS message,
          'host-' || (user_id % 7) AS host, user_id % 3 + 1 AS project_id,
          CASE WHEN event_id % 5 <> 0 THEN md5('t' || (event_id // 4)) END AS trace_id,
          substr(md5('s' || event_id), 1, 16) AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id
        FROM events"""),
    "raw": ((), r"""
        SELECT 'r' || event_id AS record_id,
          CASE WHEN event_id % 50 = 7 THEN '   ' ELSE CASE event_id % 8
            WHEN 0 THEN '{"message":"call by u' || user_id || '@example.com","level":"' || CASE event_id % 3 WHEN 0 THEN 'warn' WHEN 1 THEN 'Error' ELSE 'loud' END
                        || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","spanId":"sp-' || event_id || '"}'
            WHEN 1 THEN '{"level":"loud","n":' || event_id || '}'
            WHEN 2 THEN 'database unavailable ' || event_id || ' at 10.1.' || (user_id % 256) || '.9'
            WHEN 3 THEN '  {"message":"auto ' || event_id || '","traceId":"tr-' || event_id || '","level":null}'
            WHEN 4 THEN 'plain text of ' || user_id || ' card 4111-1111-1111-' || (1000 + event_id % 9000)
            WHEN 5 THEN '<34>1 syslog line ' || event_id
            WHEN 6 THEN '{"message":{"nested":' || event_id || '},"level":"debug"}'
            ELSE '{"timestamp":"yesterday","trace_id":"t' || event_id || '"}' END END AS message,
          CASE WHEN event_id % 61 = 3 THEN '' ELSE 'svc-' || (user_id % 5) END AS service_id,
          CASE WHEN event_id % 67 = 5 THEN NULL WHEN event_id % 8 IN (3, 4) THEN 'AUTO_DETECT'
               WHEN event_id % 8 = 5 THEN 'SYSLOG' ELSE 'JSON' END AS format,
          CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'odd' WHEN 2 THEN 'fatal' END AS level,
          CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
               WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d') END AS "timestamp",
          'host-' || (user_id % 7) AS host,
          CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'bogus' ELSE 'key-' || (user_id % 5) END AS api_key,
          CASE event_id % 9
            WHEN 0 THEN '00-' || md5('t' || event_id) || '-' || substr(md5('p' || event_id), 1, 16) || '-01'
            WHEN 1 THEN '00-' || md5('t' || event_id) || '-0000000000000000-01'
            WHEN 2 THEN '01-' || md5('t' || event_id) || '-' || substr(md5('p' || event_id), 1, 16) || '-01'
            WHEN 3 THEN '00-' || upper(md5('t' || event_id)) || '-' || substr(md5('p' || event_id), 1, 16) || '-01'
            WHEN 4 THEN ' 00-' || md5('t' || event_id) || '-' || substr(md5('p' || event_id), 1, 16) || '-00 '
            WHEN 5 THEN '00-' || md5('t' || event_id)
            WHEN 6 THEN ' ' END AS traceparent,
          CAST(99 AS BIGINT) AS project_id, 'req-' || event_id AS trace_id,
          CASE WHEN event_id % 2 = 0 THEN 'rs-' || event_id END AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id
        FROM events"""),
    "projects": ((), """
        SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS owner_id,
          sha256('key-' || s_suppkey) AS api_key_hash, s_suppkey % 4 <> 3 AS api_key_active FROM supplier"""),
    "users": ((), """
        SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email,
          c_mktsegment = 'BUILDING' AS is_external FROM customer"""),
    "user_roles": ((), """
        SELECT c_custkey AS user_id, 'USER' AS role FROM customer
        UNION ALL SELECT c_custkey, 'ADMIN' FROM customer WHERE c_nationkey = 0"""),
    "metric_defs": ((), r"""
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(n_nationkey % 3 + 1 AS BIGINT) AS project_id,
          CASE WHEN n_nationkey = 11 THEN '  ' ELSE n_name END AS name,
          CASE n_nationkey % 7 WHEN 0 THEN 'order A[0-9]+ created' WHEN 1 THEN '(?s).*heap space.*' WHEN 2 THEN '(['
            WHEN 3 THEN '.*firewall.*' WHEN 4 THEN 'userid [0-9]+ request.*' WHEN 5 THEN 'clicked'
            ELSE 'clicked.*"k": ' || n_nationkey || '.*' END AS regex_pattern FROM nation"""),
    "subs": ((), """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(n_nationkey % 4 + 1 AS BIGINT) AS project_id,
          'https://hooks.example.com/' || lower(n_name) AS url,
          repeat('secret-' || n_nationkey, n_nationkey % 9 + 1) AS secret, n_nationkey % 5 <> 0 AS active,
          TIMESTAMP '1970-01-01' + to_seconds(1700000000 + n_nationkey) AS created_at,
          TIMESTAMP '1970-01-01' + to_seconds(1700000000 + 2 * n_nationkey) AS updated_at FROM nation"""),
    "deliveries": ((), """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey % 25 + 1 AS subscription_id, 'evt-' || o_orderkey AS event_id,
          '{"order":' || o_orderkey || '}' AS payload,
          CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'DELIVERED' END
            WHEN 'O' THEN 'PENDING' ELSE 'RETRY_PENDING' END AS status,
          CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_orderkey % 5 END AS INTEGER) AS attempts,
          CAST(CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 404 ELSE 200 END WHEN 'P' THEN 503 END AS INTEGER) AS http_status,
          CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 900 + 20 END AS latency_ms,
          o_orderdate + to_seconds(o_orderkey % 3600) AS next_attempt_at,
          CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS delivered_at,
          CASE WHEN o_orderstatus = 'P' THEN 'HTTP 503: ' END AS last_error,
          o_orderdate - to_hours(o_orderkey % 24) AS created_at, o_orderdate AS updated_at FROM orders"""),
    "outcomes": ((), """
        SELECT CAST(o_orderkey AS VARCHAR) AS delivery_id,
          CAST(CASE o_orderkey % 7 WHEN 0 THEN 200 WHEN 1 THEN 500 WHEN 2 THEN 429 WHEN 3 THEN 404 WHEN 4 THEN 408 WHEN 5 THEN 204 END AS INTEGER) AS http_status,
          CASE WHEN o_orderkey % 7 = 6 THEN 'HttpTimeoutException: request timed out' END AS error,
          o_orderkey % 4000 AS latency_ms, 'body ' || (o_orderkey % 10) AS body, o_orderdate + INTERVAL 1 HOUR AS finished_at
        FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'"""),
    "dlq": ((), """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey % 25 + 1 AS subscription_id, 'evt-' || o_orderkey AS event_id,
          '{"order":' || o_orderkey || '}' AS payload, 5 AS attempts, 503 AS last_http_status, 'HTTP 503: ' AS last_error,
          o_orderdate AS failed_at, o_orderdate - to_hours(o_orderkey % 24) AS original_created_at
        FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"""),
    "done": (("deliveries", "dlq"), """
        SELECT * FROM deliveries d WHERE status = 'DELIVERED' OR (status = 'FAILED' AND NOT EXISTS (
          SELECT 1 FROM dlq q WHERE q.subscription_id = d.subscription_id AND q.event_id = d.event_id))"""),
    "chats": ((), """
        SELECT conv_id || '-' || turn AS id, 'chat-' || role AS service_id,
          CASE role WHEN 'system' THEN 'WARN' WHEN 'assistant' THEN 'INFO' ELSE 'DEBUG' END AS level,
          conv_id % 3 + 1 AS project_id, text AS message,
          TIMESTAMP '2024-01-01' + to_minutes(turn) AS "timestamp", md5(CAST(conv_id AS VARCHAR)) AS trace_id
        FROM conversations"""),
    "minute_counts": (("logs",), """
        SELECT project_id, service_id, time_bucket(INTERVAL 1 MINUTE, "timestamp") AS bucket, count(*) AS total,
          count(*) FILTER (level IN ('ERROR', 'FATAL')) AS error, count(*) FILTER (level = 'WARN') AS warn
        FROM logs GROUP BY ALL"""),
    "hour_counts": (("logs",), """
        SELECT project_id, service_id, time_bucket(INTERVAL 1 HOUR, "timestamp") AS bucket, count(*) AS total,
          count(*) FILTER (level IN ('ERROR', 'FATAL')) AS error, count(*) FILTER (level = 'WARN') AS warn
        FROM logs GROUP BY ALL"""),
    "day_windows": (("logs",), """
        SELECT project_id, service_id, date_trunc('day', "timestamp") AS window_start,
          date_trunc('day', "timestamp") + INTERVAL 1 DAY AS window_end, count(*) AS total_count,
          count(*) FILTER (level IN ('ERROR', 'FATAL')) AS error_count, count(*) FILTER (level = 'WARN') AS warning_count,
          count(*) FILTER (level IN ('ERROR', 'FATAL')) / CAST(count(*) AS DOUBLE) AS error_rate
        FROM logs GROUP BY ALL"""),
    "rate_anoms": (("day_windows",), """
        SELECT sha256(CAST(to_json([deduplication_key]) AS VARCHAR)) AS id, * FROM (
          SELECT project_id, service_id,
            CASE WHEN error_rate > 0.10 THEN 'CRITICAL' WHEN error_rate > 0.05 THEN 'HIGH' WHEN total_count > 15 THEN 'MEDIUM' END AS severity,
            project_id || ':' || service_id || ':error-rate:' || strftime(window_end, '%Y-%m-%dT%H:%M:%SZ') AS deduplication_key,
            CASE WHEN error_rate > 0.10 THEN 'CRITICAL: High error rate detected (>10%)'
                 WHEN error_rate > 0.05 THEN 'WARNING: Elevated error rate detected (>5%)'
                 WHEN total_count > 15 THEN 'NOTICE: Unusual spike in log volume detected' END AS description,
            window_end AS "timestamp", error_rate, total_count, error_count
          FROM day_windows) WHERE severity IS NOT NULL"""),
    # Hourly volumes, 7 days back, every hour up to 2024-01-30 23:00. Rules on exact integers.
    "vol_spine": (("hour_counts",), """
        SELECT project_id, service_id, unnest(generate_series(mn, least(mx + INTERVAL 7 DAY, TIMESTAMP '2024-01-30 23:00:00'), INTERVAL 1 HOUR)) AS e
        FROM (SELECT project_id, service_id, min(bucket) AS mn, max(bucket) AS mx FROM hour_counts GROUP BY ALL)"""),
    "vol_stats": (("vol_spine", "hour_counts"), """
        SELECT project_id, service_id, e, n, count(total) OVER w AS k, CAST(sum(n) OVER w AS HUGEINT) AS s,
          CAST(sum(n * n) OVER w AS HUGEINT) AS q
        FROM (SELECT p.project_id, p.service_id, p.e, c.total, coalesce(c.total, 0) AS n
              FROM vol_spine p LEFT JOIN hour_counts c ON c.project_id = p.project_id AND c.service_id = p.service_id AND c.bucket = p.e)
        WINDOW w AS (PARTITION BY project_id, service_id ORDER BY e RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)"""),
    "vol_scored": (("vol_stats",), """
        SELECT project_id, service_id, e, n, k, s / CAST(k AS DOUBLE) AS mean,
          sqrt(CAST(k * q - s * s AS DOUBLE)) / k AS sd, k * n - s AS diff, k * q - s * s AS spread FROM vol_stats WHERE k >= 10"""),
    "vol_anoms": (("vol_scored",), """
        SELECT sha256(CAST(to_json([deduplication_key]) AS VARCHAR)) AS event_id, * FROM (
        SELECT project_id, service_id, CASE WHEN spread = 0 OR diff * diff > 25 * spread THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
          project_id || ':' || service_id || ':volume:' || strftime(e, '%Y-%m-%dT%H:%M:%SZ') AS deduplication_key,
          e AS "timestamp", CASE WHEN spread = 0 THEN 10.0 ELSE CAST(diff AS DOUBLE) / sqrt(CAST(spread AS DOUBLE)) END AS z_score,
          CAST(n AS BIGINT) AS current_volume, mean AS mean_volume, sd AS std_dev, CASE WHEN diff > 0 THEN 'SPIKE' ELSE 'DROP' END AS type
        FROM vol_scored
        WHERE CASE WHEN spread = 0 THEN diff > 0 ELSE diff * diff > 9 * spread END AND (diff > 0 OR mean >= 1.0))"""),
    "anom_events": (("rate_anoms", "vol_anoms"), """
        SELECT id AS event_id, project_id, service_id, 'ERROR_RATE' AS detector, severity, deduplication_key, description, "timestamp",
          NULL AS z_score, NULL AS type, error_rate, total_count FROM rate_anoms
        UNION ALL BY NAME
        SELECT event_id, project_id, service_id, 'VOLUME_Z_SCORE' AS detector, severity, deduplication_key,
          'Volume ' || type || ' detected for service ' || service_id || ' (Z-Score: ' || format('{:.2f}', z_score) || ')' AS description,
          "timestamp", z_score, type FROM vol_anoms"""),
    "routed": (("anom_events",), "SELECT * FROM anom_events WHERE severity IN ('HIGH', 'CRITICAL')"),
    "fanned": (("routed", "subs"), """
        SELECT e.*, s.id AS subscription_id FROM routed e JOIN subs s ON s.project_id = e.project_id AND s.active"""),
    "active_keys": (("projects",), "SELECT api_key_hash, id FROM projects WHERE api_key_active"),
    "classified": (("raw", "active_keys"), r"""
        SELECT r.*, k.id AS tenant, regexp_matches(coalesce(message, ''), '[^\x00-\x20]') AS has_message,
          regexp_matches(coalesce(service_id, ''), '[^\x00-\x20]') AS has_service,
          regexp_matches(coalesce(message, ''), '[^\x00-\x20]') AND regexp_matches(coalesce(service_id, ''), '[^\x00-\x20]')
            AND format IS NOT NULL AS valid
        FROM raw r LEFT JOIN active_keys k ON trim(r.api_key) <> '' AND sha256(r.api_key) = k.api_key_hash"""),
    "traced": (("classified",), r"""
        SELECT * REPLACE (CASE WHEN ok THEN trim(traceparent)[4:35] ELSE trace_id END AS trace_id,
                          CASE WHEN ok THEN trim(traceparent)[37:52] ELSE parent_span_id END AS parent_span_id)
        FROM (SELECT *, coalesce(regexp_full_match(trim(traceparent), '00-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}')
                AND trim(traceparent)[37:52] <> '0000000000000000', false) AS ok FROM classified)"""),
    "parsed": (("traced",), r"""
        SELECT *, CASE WHEN is_json AND broken THEN 'broken' WHEN is_json THEN 'json' ELSE 'plain' END AS kind,
          CASE WHEN is_json AND NOT broken THEN json(message) END AS doc
        FROM (SELECT *, format = 'JSON' OR (format = 'AUTO_DETECT' AND starts_with(ltrim(message), '{')) AS is_json,
                NOT json_valid(message) AS broken FROM traced WHERE valid)"""),
    "entries": (("parsed",), r"""
        SELECT sha256(CAST(to_json([record_id]) AS VARCHAR)) AS id,
          CASE kind WHEN 'json' THEN coalesce(iso(doc->>'$.timestamp'), @AS_OF@)
                    WHEN 'broken' THEN coalesce(iso("timestamp"), @AS_OF@) ELSE @AS_OF@ END AS "timestamp",
          service_id,
          CASE kind WHEN 'json' THEN CASE WHEN upper(doc->>'$.level') IN ('TRACE','DEBUG','INFO','WARN','ERROR','FATAL') THEN upper(doc->>'$.level') ELSE 'INFO' END
                    WHEN 'broken' THEN CASE WHEN upper(level) IN ('TRACE','DEBUG','INFO','WARN','ERROR','FATAL') THEN upper(level) ELSE 'INFO' END END AS level,
          CASE WHEN kind = 'json' AND json_type(doc, '$.message') IN ('OBJECT', 'ARRAY') THEN ''
               WHEN kind = 'json' THEN coalesce(doc->>'$.message', message) ELSE message END AS message,
          host, message AS raw_log, tenant, project_id,
          coalesce(doc->>'$.traceId', doc->>'$.trace_id', trace_id) AS trace_id,
          coalesce(doc->>'$.spanId', doc->>'$.span_id', span_id) AS span_id, parent_span_id, kind
        FROM parsed"""),
}

ISO_TEXT = (
    r"CASE WHEN regexp_full_match({x}, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?Z') "
    r"THEN try_cast(replace(replace({x}, 'T', ' '), 'Z', '') AS TIMESTAMP) END"
)


def redacted(column: str) -> str:
    """The three redaction rules as nested replacements."""
    email = rf"regexp_replace({column}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b', '[REDACTED_EMAIL]', 'g')"
    ip = rf"regexp_replace({email}, '\b\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\b', '[REDACTED_IP]', 'g')"
    return rf"regexp_replace({ip}, '\b(?:\d[ -]*?){{13,16}}\b', '[REDACTED_CC]', 'g')"


def _expand(names: tuple[str, ...], done: dict[str, str]) -> dict[str, str]:
    for name in names:
        if name not in done:
            needs, text = _PARTS[name]
            _expand(needs, done)
            text = text.replace("@AS_OF@", AS_OF)
            for arg in ("doc->>'$.timestamp'", '"timestamp"'):
                text = text.replace(f"iso({arg})", ISO_TEXT.format(x=arg))
            done[name] = text
    return done


def sql(body: str, *parts: str) -> str:
    """A statement with the named parts, and those they need, as common table expressions."""
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in _expand(parts, {}).items())
    return f"WITH {ctes}\n{body}" if ctes else body
