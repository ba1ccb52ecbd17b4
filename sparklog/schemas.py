"""Explicit schemas of every table. Nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T


def table(**columns: str | T.DataType) -> T.StructType:
    """A schema from column names and type names; needs no running session."""
    schema = T.StructType()
    for name, kind in columns.items():
        schema.add(name, kind)
    return schema


# What a sender gives; the readers add ``record_id`` from the place in the source.
LOG_RAW = table(
    message="string", service_id="string", format="string", level="string", timestamp="string", host="string",
    api_key="string", traceparent="string", project_id="long", trace_id="string", span_id="string",
    parent_span_id="string",
)

LOG_ENTRY = table(
    id="string", timestamp="timestamp", service_id="string", level="string", message="string", host="string",
    metadata=T.MapType(T.StringType(), T.StringType()), tags=T.ArrayType(T.StringType()), raw_log="string",
    ingestion_timestamp="timestamp", project_id="long", trace_id="string", span_id="string", parent_span_id="string",
)

LOG_DOCUMENT = table(
    id="string", service_id="string", level="string", project_id="long", message="string", timestamp="timestamp",
    trace_id="string", span_id="string", parent_span_id="string",
)

INGEST_ERROR = table(id="string", message="string")

# Log entry columns, then the outcome and the error of a failed row.
INGEST_OUTCOME = T.StructType([*LOG_ENTRY.fields]).add("error_id", "string").add("error", "string").add("outcome", "string")

MINUTE_COUNTS = table(
    project_id="long", service_id="string", bucket="timestamp", total="long", error="long", warn="long"
)

METRIC_COUNTS = table(project_id="long", metric_id="long", bucket="timestamp", count="long")

ERROR_RATE_WINDOWS = table(
    project_id="long", service_id="string", window_start="timestamp", window_end="timestamp", total_count="long",
    error_count="long", warning_count="long", error_rate="double",
)

ERROR_RATE_ANOMALY = table(
    id="string", schema_version="integer", event_type="string", project_id="long", service_id="string",
    detector="string", severity="string", deduplication_key="string", description="string", timestamp="timestamp",
    metrics=table(error_rate="double", total_count="long", error_count="long"),
)

VOLUME_ANOMALY = table(
    schema_version="integer", event_type="string", event_id="string", project_id="long", service_id="string",
    detector="string", severity="string", deduplication_key="string", timestamp="timestamp", z_score="double",
    current_volume="long", mean_volume="double", std_dev="double", type="string",
)

ANOMALY_EVENT = table(
    schema_version="integer", event_type="string", event_id="string", project_id="long", service_id="string",
    detector="string", severity="string", deduplication_key="string", description="string", timestamp="timestamp",
    metrics=table(
        z_score="double", current_volume="long", mean_volume="double", std_dev="double", type="string",
        error_rate="double", total_count="long", error_count="long",
    ),
)

PROJECTS = table(id="long", name="string", owner_id="long", api_key_hash="string", api_key_active="boolean")
USERS = table(id="long", email="string")
USER_ROLES = table(user_id="long", role="string")
CUSTOM_METRICS = table(
    id="long", project_id="long", name="string", regex_pattern="string", created_at="timestamp_ntz"
)
SUBSCRIPTIONS = table(
    id="long", project_id="long", url="string", secret="string", active="boolean", created_at="timestamp",
    updated_at="timestamp",
)
# Delivery ids are text: new rows get a stable id derived from (subscription, event).
DELIVERIES = table(
    id="string", subscription_id="long", event_id="string", payload="string", status="string", attempts="integer",
    http_status="integer", latency_ms="long", next_attempt_at="timestamp", delivered_at="timestamp",
    last_error="string", created_at="timestamp", updated_at="timestamp",
)
DLQ = table(
    id="string", subscription_id="long", event_id="string", payload="string", attempts="integer",
    last_http_status="integer", last_error="string", failed_at="timestamp", original_created_at="timestamp",
)
OUTCOMES = table(
    delivery_id="string", http_status="integer", error="string", latency_ms="long", body="string",
    finished_at="timestamp",
)

DIMENSIONS = {
    "projects": PROJECTS,
    "users": USERS,
    "user_roles": USER_ROLES,
    "custom_metrics": CUSTOM_METRICS,
    "webhook_subscriptions": SUBSCRIPTIONS,
    "webhook_deliveries": DELIVERIES,
    "webhook_dlq": DLQ,
}
