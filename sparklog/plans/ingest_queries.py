"""Ingest, tenancy and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparklog import schemas
from sparklog.functions.clock import MINUTE_KEY, bucket_start, bucket_text, instant, parse_bucket, parse_event_time
from sparklog.functions.keys import dedup_key, hash_api_key
from sparklog.functions.levels import level_severity
from sparklog.functions.text import preview
from sparklog.operators import ingest as ing
from sparklog.operators import tenancy
from sparklog.operators.search import to_log_documents
from sparklog.plans.oracle import AS_OF, redacted, sql
from sparklog.plans.registry import query
from sparklog.session import scratch_dir
from sparklog.sources import tables as t
from sparklog.sources.readers import read_dim, read_raw_logs
from sparklog.sources.sinks import documents_store, keyed_logs, read_documents, write_outcomes
from sparklog.streaming.jobs import unstored

RAW_COLUMNS = "record_id, message, service_id, format, level, \"timestamp\", host, api_key, traceparent, project_id, trace_id, span_id, parent_span_id"
ENTRY_COLUMNS = ["id", "timestamp", "service_id", "level", "message", "host", "raw_log", "project_id",
                 "trace_id", "span_id", "parent_span_id"]


@query("validate_raw_valid", sql(f"SELECT {RAW_COLUMNS} FROM classified WHERE valid", "classified"))
def validate_raw_valid(spark, d):
    return ing.validate_raw(t.raw_logs(spark, d))[0]


@query("validate_raw_invalid", sql("""
    SELECT record_id, concat_ws('; ', CASE WHEN NOT has_message THEN 'message=Log message cannot be blank' END,
      CASE WHEN NOT has_service THEN 'serviceId=Service ID is required' END,
      CASE WHEN format IS NULL THEN 'format=Format must be specified' END) AS errors
    FROM classified WHERE NOT valid""", "classified"))
def validate_raw_invalid(spark, d):
    invalid = ing.validate_raw(t.raw_logs(spark, d))[1]
    text = F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return invalid.select("record_id", text.alias("errors"))


@query("parse_traceparent", sql("SELECT record_id, trace_id, parent_span_id FROM traced", "traced"))
def parse_traceparent(spark, d):
    return ing.parse_traceparent(t.raw_logs(spark, d)).select("record_id", "trace_id", "parent_span_id")


def _raw_for_parser(spark, d):
    return ing.parse_traceparent(ing.validate_raw(t.raw_logs(spark, d))[0])


@query("parse_logs", sql(
    'SELECT id, "timestamp", service_id, level, message, host, raw_log, project_id, trace_id, span_id, parent_span_id FROM entries',
    "entries"))
def parse_logs(spark, d):
    return ing.parse_logs(_raw_for_parser(spark, d), t.AS_OF).select(*ENTRY_COLUMNS)


@query("parse_logs_strict", sql("""
    SELECT id, level, CASE WHEN kind <> 'plain' THEN trace_id END AS trace_id,
      CASE WHEN kind <> 'plain' THEN span_id END AS span_id,
      CASE WHEN kind <> 'plain' THEN parent_span_id END AS parent_span_id FROM entries""", "entries"))
def parse_logs_strict(spark, d):
    return ing.parse_logs(_raw_for_parser(spark, d), t.AS_OF, strict=True).select(
        "id", "level", "trace_id", "span_id", "parent_span_id"
    )


@query("level_severity", sql("""
    SELECT id, CASE level WHEN 'TRACE' THEN 1 WHEN 'DEBUG' THEN 2 WHEN 'INFO' THEN 3 WHEN 'WARN' THEN 4
      WHEN 'ERROR' THEN 5 WHEN 'FATAL' THEN 6 END AS severity FROM logs""", "logs"))
def severity(spark, d):
    return t.logs(spark, d).select("id", level_severity(F.col("level")).alias("severity"))


@query("redact_pii_documents", f"SELECT doc_id, {redacted('text')} AS text FROM documents")
def redact_documents(spark, d):
    return ing.redact_pii(t.table(spark, d, "documents").select("doc_id", "text"), ("text",))


@query("redact_pii_pages", f"SELECT page_id, {redacted('html')} AS html FROM pages")
def redact_pages(spark, d):
    return ing.redact_pii(t.table(spark, d, "pages").select("page_id", "html"), ("html",))


@query("redact_pii_logs", sql(f"SELECT id, {redacted('message')} AS message FROM logs", "logs"))
def redact_logs(spark, d):
    return ing.redact_pii(t.logs(spark, d).select("id", "message"), ("message",))


@query("ingest_logs", sql(f"""
    SELECT id, "timestamp", service_id, level, {redacted('message')} AS message, host, {redacted('raw_log')} AS raw_log,
      tenant AS project_id, trace_id, span_id, parent_span_id FROM entries WHERE tenant IS NOT NULL""", "entries"))
def ingest_logs(spark, d):
    return ing.ingest(t.raw_logs(spark, d), t.projects(spark, d), t.AS_OF)[0].select(*ENTRY_COLUMNS)


@query("ingest_errors", sql(f"""
    SELECT record_id AS id, 'Failed processing log: ' || CASE WHEN valid THEN 'Invalid or missing API Key'
      ELSE 'Validation Failed: ' || concat_ws('; ', CASE WHEN NOT has_message THEN 'Log message cannot be blank' END,
        CASE WHEN NOT has_service THEN 'Service ID is required' END, CASE WHEN format IS NULL THEN 'Format must be specified' END) END
      || ' | Raw: ' || {redacted('message')} AS message
    FROM classified WHERE NOT valid OR tenant IS NULL""", "classified"))
def ingest_errors(spark, d):
    return ing.ingest_errors(t.raw_logs(spark, d), t.projects(spark, d))


@query("ingest_status", sql(f"""
    SELECT CASE WHEN valid AND tenant IS NOT NULL THEN sha256(CAST(to_json([record_id]) AS VARCHAR)) END AS id,
      CASE WHEN valid AND tenant IS NOT NULL THEN 'ACCEPTED' ELSE 'ERROR' END AS status,
      CASE WHEN NOT valid THEN 'Validation Failed' WHEN tenant IS NULL THEN 'Invalid or missing API Key'
           ELSE 'Log accepted for processing' END AS message, {AS_OF} AS "timestamp" FROM classified""", "classified"))
def ingest_status(spark, d):
    return ing.ingest_status(t.raw_logs(spark, d), t.projects(spark, d), t.AS_OF)


@query("ingest_stats", sql(f"""
    SELECT 'ingested' AS metric, count(*) AS count, CAST(sum(ms) AS BIGINT) AS total_delay_ms, max(ms) AS max_delay_ms
    FROM (SELECT CAST(trunc((epoch_us({AS_OF}) - epoch_us("timestamp")) / 1000) AS BIGINT) AS ms FROM entries WHERE tenant IS NOT NULL)
    UNION ALL SELECT 'errors', count(*), NULL, NULL FROM classified WHERE NOT valid OR tenant IS NULL""", "entries"))
def ingest_stats(spark, d):
    return ing.ingest_stats(ing.ingest_outcomes(t.raw_logs(spark, d), t.projects(spark, d), t.AS_OF))


@query("resolve_tenant", sql("SELECT record_id, tenant AS project_id FROM classified WHERE tenant IS NOT NULL", "classified"))
def resolve_tenant(spark, d):
    return ing.resolve_tenant(t.raw_logs(spark, d), t.projects(spark, d)).select("record_id", "project_id")


@query("unauthorized", sql("SELECT record_id, api_key FROM classified WHERE tenant IS NULL", "classified"))
def unauthorized(spark, d):
    return ing.unauthorized(t.raw_logs(spark, d), t.projects(spark, d)).select("record_id", "api_key")


@query("hash_api_key", "SELECT s_suppkey, sha256('key-' || s_suppkey) AS api_key_hash FROM supplier")
def api_key_hashes(spark, d):
    return t.table(spark, d, "supplier").select(
        "s_suppkey", hash_api_key(F.concat(F.lit("key-"), "s_suppkey")).alias("api_key_hash")
    )


@query("parse_event_time", f"""
    SELECT event_id, CASE event_id % 4
      WHEN 0 THEN date_trunc('second', ts)
      WHEN 1 THEN date_trunc('second', ts)
      ELSE {AS_OF} END AS "timestamp" FROM events""")
def event_times(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    text = F.expr("event_id % 4")
    shown = (
        F.when(text == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(text == 1, F.concat(seconds.cast("string"), F.lit(".75")))
        .when(text == 2, F.date_format("ts", "yyyy-MM-dd"))
    )
    events = t.table(spark, d, "events").withColumn("shown", shown)
    return events.select("event_id", parse_event_time(F.col("shown"), instant(t.AS_OF)).alias("timestamp"))


@query("decode_log_events", sql(f"""
    SELECT id, CASE WHEN n % 3 = 2 THEN {AS_OF} ELSE date_trunc('second', "timestamp") END AS "timestamp",
      CASE WHEN n % 5 = 0 THEN '' ELSE service_id END AS service_id, level, message,
      CASE WHEN n % 7 <> 0 THEN project_id END AS project_id, trace_id, span_id, parent_span_id
    FROM (SELECT *, CAST(id AS BIGINT) AS n FROM logs) WHERE level <> 'FATAL'""", "logs"))
def decoded(spark, d):
    n = F.col("id").cast("bigint")
    logs = t.logs(spark, d)
    time = F.when(n % 3 == 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(
        n % 3 == 1, F.unix_seconds("timestamp").cast("string"))
    event = F.struct(
        "id", time.alias("timestamp"), F.when(n % 5 != 0, F.col("service_id")).alias("serviceId"), "level", "message",
        F.when(n % 7 != 0, F.col("project_id")).alias("projectId"), F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
    )
    value = F.when(F.col("level") == "FATAL", F.concat(F.lit("{broken "), "id")).otherwise(F.to_json(event))
    return ing.decode_log_events(logs.select(value.alias("value")), "value", t.AS_OF)[0]


@query("with_bucket", """
    SELECT event_id, time_bucket(INTERVAL 1 MINUTE, ts) AS bucket, strftime(ts, '%Y-%m-%dT%H:%M') AS text,
      strftime(ts, '%Y%m%d%H%M') AS key, time_bucket(INTERVAL 1 MINUTE, ts) AS parsed, CAST(NULL AS TIMESTAMP) AS unreadable
    FROM events""")
def with_bucket(spark, d):
    ts = F.col("ts").cast("timestamp")
    text = bucket_text(ts)
    return t.table(spark, d, "events").select(
        "event_id", bucket_start(ts, "1 minute").alias("bucket"), text.alias("text"),
        bucket_text(ts, MINUTE_KEY).alias("key"), parse_bucket(text).alias("parsed"),
        parse_bucket(F.col("event_type")).alias("unreadable"),
    )


@query("dedup_key", sql("""
    SELECT id, project_id || ':' || service_id || ':volume:' || strftime("timestamp", '%Y-%m-%dT%H:%M:00Z') AS deduplication_key
    FROM logs""", "logs"))
def dedup_keys(spark, d):
    minute = bucket_start(F.col("timestamp"), "1 minute")
    return t.logs(spark, d).select(
        "id", dedup_key(F.col("project_id"), F.col("service_id"), "volume", minute).alias("deduplication_key")
    )


@query("preview_text", r"""
    SELECT doc_id, CASE WHEN length(c) > 90 THEN substring(c, 1, 90) || '...' ELSE c END AS preview FROM (
      SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text,
        '[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')), '={3,}', '', 'g')) AS c
      FROM documents)""")
def previews(spark, d):
    return t.table(spark, d, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@query("to_log_documents", sql(f"""
    SELECT id, service_id, level, tenant AS project_id, {redacted('message')} AS message, "timestamp", trace_id, span_id, parent_span_id
    FROM entries WHERE tenant IS NOT NULL""", "entries"))
def log_documents(spark, d):
    """The same records sent twice give each document once."""
    raw = t.raw_logs(spark, d)
    logs, _ = ing.ingest(raw.unionByName(raw), t.projects(spark, d), t.AS_OF)
    return to_log_documents(logs)


@query("write_logs", sql("""
    SELECT project_id || ':' || service_id AS key, id, level, message, project_id, trace_id, "timestamp" FROM logs""", "logs"))
def keyed(spark, d):
    rows = keyed_logs(t.logs(spark, d))

    def field(name):
        return F.get_json_object("value", f"$.{name}")

    return rows.select(
        "key", field("id").alias("id"), field("level").alias("level"), field("message").alias("message"),
        field("projectId").cast("bigint").alias("project_id"), field("traceId").alias("trace_id"),
        field("timestamp").cast("timestamp").alias("timestamp"),
    )


@query("ingest_identity", sql("""
    SELECT tenant AS project_id, service_id, CAST(count(*) + count(*) FILTER (CAST(substr(record_id, 2) AS BIGINT) % 3 = 0) AS BIGINT) AS documents
    FROM classified WHERE valid AND tenant IS NOT NULL GROUP BY ALL""", "classified"))
def ingest_identity(spark, d):
    """Documents of JSON lines without ids, a third of which were delivered twice: every line is a record of its own."""
    root = scratch_dir(spark, "identity")
    raw = t.raw_logs(spark, d)
    again = raw.where("cast(substr(record_id, 2) as bigint) % 3 = 0")
    raw.unionByName(again).drop("record_id").write.json(f"{root}/raw")
    logs, _ = ing.ingest(read_raw_logs(spark, f"{root}/raw"), t.projects(spark, d), t.AS_OF)
    return to_log_documents(logs).groupBy("project_id", "service_id").agg(F.count(F.lit(1)).alias("documents"))


@query("ingest_growing_folder", sql("""
    SELECT tenant AS project_id, service_id, count(*) AS documents FROM classified WHERE valid AND tenant IS NOT NULL GROUP BY ALL""", "classified"))
def ingest_growing_folder(spark, d):
    """A folder that is ingested, grows and is ingested again with other split settings: every record is one document."""
    root = scratch_dir(spark, "growing")
    raw = t.raw_logs(spark, d)
    old = F.expr("cast(substr(record_id, 2) as bigint) % 4 > 0")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for part, batch, split in ((raw.where(old).repartition(3), 1, size), (raw.where(~old).coalesce(1), 2, "1m")):
            part.drop("record_id").write.mode("append").json(f"{root}/raw")
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            logs, _ = ing.ingest(read_raw_logs(spark, f"{root}/raw"), t.projects(spark, d), t.AS_OF)
            store = documents_store(spark, f"{root}/docs")
            store.commit(unstored(to_log_documents(logs), store), batch)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return read_documents(spark, f"{root}/docs").groupBy("project_id", "service_id").agg(F.count(F.lit(1)).alias("documents"))


@query("outcome_status", sql("""
    SELECT CASE WHEN valid AND tenant IS NOT NULL THEN 'ACCEPTED' ELSE 'ERROR' END AS status,
      CASE WHEN NOT valid THEN 'Validation Failed' WHEN tenant IS NULL THEN 'Invalid or missing API Key'
           ELSE 'Log accepted for processing' END AS message, count(*) AS records,
      count(*) FILTER (valid AND tenant IS NOT NULL) AS stored FROM classified GROUP BY ALL""", "classified"))
def outcome_status(spark, d):
    """Answers to records that came without an id: each accepted one names a stored log."""
    root = scratch_dir(spark, "answers")
    write_outcomes(ing.ingest_outcomes(t.raw_logs(spark, d).drop("record_id"), t.projects(spark, d), t.AS_OF), root)
    stored = spark.read.schema(schemas.INGEST_OUTCOME).parquet(root)
    logs, _ = ing.split_outcomes(stored)
    answers = ing.outcome_status(stored).join(logs.select("id", F.lit(1).alias("one")), "id", "left")
    return answers.groupBy("status", "message").agg(F.count(F.lit(1)).alias("records"), F.count("one").alias("stored"))


@query("dimension_scans", sql("""
    SELECT 'projects' AS name, count(*) AS records, CAST(sum(id) AS BIGINT) AS ids FROM projects
    UNION ALL SELECT 'users', count(*), CAST(sum(id) AS BIGINT) FROM users
    UNION ALL SELECT 'custom_metrics', count(*), CAST(sum(id) AS BIGINT) FROM metric_defs""", "projects", "users", "metric_defs"))
def dimension_scans(spark, d):
    """Dimension tables through their reader, with the reader's schema."""
    root, found = scratch_dir(spark, "dims"), []
    for name, table in (("projects", t.projects), ("users", t.users), ("custom_metrics", t.custom_metrics)):
        table(spark, d).write.parquet(f"{root}/{name}")
        rows = read_dim(spark, name, f"{root}/{name}")
        found.append(rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("records"), F.sum("id").alias("ids")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("restrict_to_user", sql("""
    SELECT id, project_id FROM logs WHERE project_id IN (
      SELECT p.id FROM projects p JOIN users u ON u.id = p.owner_id WHERE u.email = 'user20@example.com')""",
    "logs", "projects", "users"))
def restricted(spark, d):
    mine = tenancy.restrict_to_user(t.logs(spark, d), t.projects(spark, d), t.users(spark, d), "user20@example.com")
    return mine.select("id", "project_id")


@query("projects_of", sql("""
    SELECT p.id, p.id AS project_id, p.name FROM projects p JOIN users u ON u.id = p.owner_id
    WHERE u.email = 'user20@example.com'""", "projects", "users"))
def projects_of(spark, d):
    return tenancy.projects_of(t.users(spark, d), t.projects(spark, d), "user20@example.com")


@query("purge_users", sql("SELECT id, email FROM users WHERE NOT is_external", "users"))
def purged_users(spark, d):
    kept, _ = tenancy.purge_users(t.users(spark, d), t.user_roles(spark, d), "is_external")
    return kept.select("id", "email")


@query("purge_user_roles", sql(
    "SELECT r.user_id, r.role FROM user_roles r JOIN users u ON u.id = r.user_id WHERE NOT u.is_external", "users", "user_roles"))
def purged_roles(spark, d):
    return tenancy.purge_users(t.users(spark, d), t.user_roles(spark, d), "is_external")[1]


@query("table_counts", sql("""
    SELECT 'Users remaining:' AS info, count(*) AS count FROM users WHERE NOT is_external
    UNION ALL SELECT 'Projects remaining:', count(*) FROM projects""", "users", "projects"))
def remaining(spark, d):
    kept, _ = tenancy.purge_users(t.users(spark, d), t.user_roles(spark, d), "is_external")
    return tenancy.table_counts({"Users remaining:": kept, "Projects remaining:": t.projects(spark, d)})
