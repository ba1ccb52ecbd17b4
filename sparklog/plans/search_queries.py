"""Search, feed, trace and annotation queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sparklog.operators import search as se
from sparklog.plans.anomaly_queries import ANOMALY_LOGS, volume_anomalies
from sparklog.plans.oracle import sql
from sparklog.plans.registry import query
from sparklog.session import scratch_dir
from sparklog.sources import tables as t
from sparklog.sources.sinks import write_documents
from sparklog.sources.token_index import search_indexed, update_postings

DOC = 'id, service_id, level, project_id, message, "timestamp", trace_id, span_id'
COLUMNS = ["id", "service_id", "level", "project_id", "message", "timestamp", "trace_id", "span_id"]


def docs(spark, d):
    return se.to_log_documents(t.logs(spark, d), dedup=False)


def found(where: str) -> str:
    return sql(f"SELECT {DOC} FROM logs WHERE project_id = 2 AND {where}", "logs")


@query("search_logs_all", found("true"))
def search_all(spark, d):
    return se.search_logs(docs(spark, d), 2, " ").select(*COLUMNS)


@query("search_logs_keyword", found("contains(lower(message), 'heap space')"))
def search_keyword(spark, d):
    return se.search_logs(docs(spark, d), 2, "Heap Space").select(*COLUMNS)


@query("search_logs_token", found(
    r"len(list_filter(regexp_split_to_array(lower(message), '[^\pL\pN_]+'), lambda w: contains(w, 'fire'))) > 0"))
def search_token(spark, d):
    return se.search_logs(docs(spark, d), 2, "Fire", mode="token").select(*COLUMNS)


@query("search_indexed_token", found(
    r"len(list_filter(regexp_split_to_array(lower(message), '[^\pL\pN_]+'), lambda w: contains(w, 'u12'))) > 0"))
def search_indexed_token(spark, d):
    """Through token postings, over a store whose last batch has none yet."""
    root = scratch_dir(spark, "postings")
    rows = docs(spark, d)
    late = F.expr("cast(id as bigint) % 5 = 0")
    write_documents(rows.where(~late), root, 1)
    update_postings(spark, root)
    write_documents(rows.where(late), root, 2)
    return search_indexed(spark, root, 2, "U12").select(*COLUMNS)


@query("search_documents_token", r"""
    SELECT doc_id FROM documents
    WHERE len(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN_]+'), lambda w: contains(w, 'tion'))) > 0""")
def search_documents(spark, d):
    """Token search over whole document texts, every source as one project."""
    rows = t.table(spark, d, "documents").select("doc_id", F.col("text").alias("message"), F.lit(1).alias("project_id"))
    return se.search_logs(rows, 1, "TION", mode="token").select("doc_id")


@query("search_by_service", found("service_id = 'svc-1'"))
def by_service(spark, d):
    return se.search_by_service(docs(spark, d), 2, "svc-1").select(*COLUMNS)


@query("search_by_level", found("level = 'FATAL'"))
def by_level(spark, d):
    return se.search_by_level(docs(spark, d), 2, "FATAL").select(*COLUMNS)


@query("search_by_trace", sql(f"SELECT {DOC} FROM logs WHERE project_id = 2 AND trace_id = md5('t7')", "logs"))
def by_trace(spark, d):
    return se.search_by_trace(docs(spark, d), 2, hashlib.md5(b"t7").hexdigest()).select(*COLUMNS)


@query("recent_logs", sql(f'SELECT {DOC} FROM logs WHERE project_id = 1 ORDER BY "timestamp" DESC, id LIMIT 200', "logs"))
def recent(spark, d):
    """A top-k report: the limit is the feature."""
    return se.recent_logs(docs(spark, d), 1, limit=200).select(*COLUMNS)


@query("logs_before", sql(f"SELECT {DOC} FROM logs WHERE \"timestamp\" < TIMESTAMP '2024-01-15 00:00:00'", "logs"))
def before(spark, d):
    return se.logs_before(docs(spark, d), "2024-01-15T00:00:00").select(*COLUMNS)


@query("list_services", sql("SELECT DISTINCT service_id FROM logs WHERE project_id = 3", "logs"))
def services(spark, d):
    return se.list_services(docs(spark, d), 3)


FEED = f"""(SELECT id, service_id, level, project_id, message, "timestamp", trace_id FROM logs
  UNION ALL BY NAME {ANOMALY_LOGS})"""
FEED_COLUMNS = ["id", "service_id", "level", "project_id", "message", "timestamp", "trace_id"]


@query("console_feed", sql(f"SELECT * FROM {FEED}", "logs", "vol_anoms"))
def feed(spark, d):
    return se.console_feed(docs(spark, d), volume_anomalies(spark, d)).select(*FEED_COLUMNS)


@query("console_feed_project", sql(f"""
    SELECT *, row_number() OVER (ORDER BY "timestamp" DESC NULLS LAST, id) AS place FROM (
      SELECT * FROM {FEED} WHERE project_id = 3 ORDER BY "timestamp" DESC NULLS LAST, id LIMIT 200)""", "logs", "vol_anoms"))
def project_feed(spark, d):
    """The first page of one project, with the place of each row as the feed orders it."""
    rows = se.console_feed(docs(spark, d), volume_anomalies(spark, d), project_id=3, limit=200)
    places = rows.agg(F.collect_list(F.struct(*FEED_COLUMNS)).alias("rows")).select(F.posexplode("rows"))
    return places.select("col.*", (F.col("pos") + 1).cast("bigint").alias("place"))


@query("console_filter", sql(f"""
    SELECT * FROM {FEED} WHERE (contains(lower(message), 'volume') OR contains(lower(service_id), 'volume'))
      AND service_id = 'svc-2' AND level = 'ANOMALY'""", "logs", "vol_anoms"))
def filtered(spark, d):
    rows = se.console_feed(docs(spark, d), volume_anomalies(spark, d), order=False)
    return se.console_filter(rows, "VOLUME", "svc-2", "ANOMALY").select(*FEED_COLUMNS)


@query("feed_services", sql(f"SELECT 'ALL' AS service_id UNION ALL SELECT DISTINCT service_id FROM {FEED}", "logs", "vol_anoms"))
def feed_services(spark, d):
    return se.feed_services(se.console_feed(docs(spark, d), volume_anomalies(spark, d), order=False))


def _groups(source: str) -> str:
    return f"""
    SELECT project_id, trace_id, count(*) AS records, max("timestamp") AS "timestamp",
      max(service_id) FILTER (rn = 1) AS service_id,
      CASE WHEN bool_or(level = 'ERROR') THEN 'ERROR' WHEN bool_or(level = 'WARN') THEN 'WARN'
           ELSE max(level) FILTER (rn = 1) END AS level, 'group' AS kind, CAST(NULL AS VARCHAR) AS id
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY "timestamp" DESC, id) AS rn
          FROM {source} WHERE trace_id <> '') GROUP BY project_id, trace_id
    UNION ALL SELECT project_id, NULL, 1, "timestamp", service_id, level, 'standalone', id FROM {source}
    WHERE trace_id IS NULL OR trace_id = ''"""


@query("trace_groups", sql(_groups("logs"), "logs"))
def groups(spark, d):
    return se.trace_groups(docs(spark, d))


@query("trace_groups_conversations", sql(_groups("chats"), "chats"))
def chat_groups(spark, d):
    return se.trace_groups(t.conversation_docs(spark, d))


_SHORT = r"""trim(regexp_replace(trim(regexp_replace(message,
  '[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')), '={3,}', '', 'g'))"""


def _preview(source: str) -> str:
    return f"""
    SELECT project_id, trace_id, id, level, CASE WHEN length(c) > 90 THEN substring(c, 1, 90) || '...' ELSE c END AS preview
    FROM (SELECT *, {_SHORT} AS c, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY
            CASE level WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END,
            CASE WHEN level IN ('ERROR', 'WARN') THEN -epoch_us("timestamp") ELSE epoch_us("timestamp") END, id) AS rn
          FROM {source} WHERE trace_id <> '') WHERE rn = 1"""


@query("trace_preview", sql(_preview("logs"), "logs"))
def previews(spark, d):
    return se.trace_preview(docs(spark, d))


@query("trace_preview_conversations", sql(_preview("chats"), "chats"))
def chat_previews(spark, d):
    return se.trace_preview(t.conversation_docs(spark, d))


@query("annotate_logs", sql(r"""
    SELECT id, CASE WHEN is_order THEN 'Order Created' WHEN is_login THEN 'Login Request' END AS action,
      CASE WHEN is_login THEN regexp_extract(message, 'userid\s+(\S+)\s+request for login', 1, 'i') END AS "user",
      CASE WHEN NOT faulty THEN NULL WHEN contains(m, 'database connection refused') THEN 'Database unreachable or credentials invalid.'
        WHEN contains(m, 'outofmemoryerror') OR contains(m, 'java heap space') THEN 'JVM Heap Memory Exhausted.'
        WHEN contains(m, 'nullpointerexception') THEN 'Attempted to invoke method on null object reference.'
        WHEN contains(m, 'timeout') AND contains(m, 'firewall') THEN 'Routine firewall handshake timeout.'
        ELSE 'Unhandled Exception Occurred.' END AS root_cause,
      faulty AND contains(m, 'timeout') AND contains(m, 'firewall') AS is_ignorable,
      CASE WHEN is_order THEN 'Order ID ' || regexp_extract(message, 'order\s+(\S+)\s+created', 1, 'i') || ' was successfully processed.'
        WHEN is_login THEN 'User initiated authentication sequence.'
        WHEN stack THEN split_part(message, chr(10), 1) ELSE message END AS extracted_message, stack AS has_stack_trace,
      CASE WHEN faulty AND NOT (contains(m, 'timeout') AND contains(m, 'firewall')) THEN true ELSE false END AS has_fix
    FROM (SELECT *, lower(message) AS m, level IN ('ERROR', 'WARN') AS faulty,
            level = 'INFO' AND regexp_matches(message, 'userid\s+\S+\s+request for login', 'i') AS is_login,
            level = 'INFO' AND regexp_matches(message, 'order\s+\S+\s+created', 'i') AS is_order,
            contains(message, 'Exception') OR contains(message, 'at org.springframework') OR contains(message, chr(9) || 'at ') AS stack
          FROM logs)""", "logs"))
def annotated(spark, d):
    rows = se.annotate_logs(docs(spark, d))
    return rows.select(
        "id", "action", "user", "root_cause", "is_ignorable", "extracted_message", "has_stack_trace",
        F.col("suggested_fix").isNotNull().alias("has_fix"),
    )
