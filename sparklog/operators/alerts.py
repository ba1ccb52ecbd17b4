"""Anomaly events: one shape, routing, messages, fan-out to subscriptions, signing, URL policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog import constants as C
from sparklog.functions.clock import instant, parse_event_time
from sparklog.functions.keys import hmac_pads, hmac_sha256
from sparklog.functions.urls import is_blocked_address, literal_address, url_error, url_host
from sparklog.operators.ingest import When
from sparklog.operators.joins import join_dim
from sparklog.schemas import ANOMALY_EVENT

_WIRE = (
    "schemaVersion string, eventType string, eventId string, id string, projectId string, serviceId string, "
    "detector string, severity string, deduplicationKey string, description string, timestamp string, "
    "zScore string, currentVolume string, meanVolume string, stdDev string, type string, "
    "metrics struct<errorRate:double,totalCount:bigint,errorCount:bigint>"
)


def _conform(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ANOMALY_EVENT.fields])


def _metrics(**known: Column) -> Column:
    fields = ANOMALY_EVENT["metrics"].dataType.fields
    return F.struct(*[
        known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])


# --- normal form ----------------------------------------------------------------------------------------

def normalize_anomalies(df: DataFrame, col: str, as_of: When, strict: bool = False) -> DataFrame:
    """Anomaly events from the JSON text of either detector; text that is not JSON is dropped.

    The error-rate shape has ``id`` where alerts need ``event_id``, and its own description and metrics:
    they are kept, unless ``strict=True``.
    """
    w = df.select(F.from_json(F.col(col), _WIRE).alias("w"), F.try_parse_json(F.col(col)).alias("_doc"))
    w = w.where(F.col("_doc").isNotNull()).select("w.*")
    volume_fields = [F.col(c) for c in ("zScore", "currentVolume", "meanVolume", "stdDev", "type")]
    has_volume = F.coalesce(*volume_fields).isNotNull()
    has_rate = F.col("metrics").isNotNull()

    def number(name: str, kind: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.coalesce(F.col(name).try_cast(kind), F.lit(0).cast(kind)))

    metrics = F.when(has_volume | (F.lit(not strict) & has_rate), _metrics(
        z_score=number("zScore", "double"), current_volume=number("currentVolume", "bigint"),
        mean_volume=number("meanVolume", "double"), std_dev=number("stdDev", "double"), type=F.col("type"),
        **({} if strict else {
            "error_rate": F.col("metrics.errorRate"), "total_count": F.col("metrics.totalCount"),
            "error_count": F.col("metrics.errorCount"),
        }),
    ))
    text = F.format_string(
        "Volume %s detected for service %s (Z-Score: %.2f)",
        F.col("type"), F.col("serviceId"), F.coalesce(number("zScore", "double"), F.lit(0.0)),
    )
    return _conform(w.select(
        F.coalesce(number("schemaVersion", "int"), F.lit(0)).alias("schema_version"),
        F.col("eventType").alias("event_type"),
        (F.col("eventId") if strict else F.coalesce("eventId", "id")).alias("event_id"),
        number("projectId", "bigint").alias("project_id"),
        F.col("serviceId").alias("service_id"),
        "detector", "severity", F.col("deduplicationKey").alias("deduplication_key"),
        F.when(F.col("type").isNotNull(), text)
        .when(F.lit(not strict), F.col("description")).alias("description"),
        F.when(F.col("timestamp").isNotNull(), parse_event_time(F.col("timestamp"), instant(as_of)))
        .alias("timestamp"),
        metrics.alias("metrics"),
    ))


def rate_events(rate: DataFrame) -> DataFrame:
    """Error-rate anomalies as anomaly events."""
    return _conform(rate.withColumnRenamed("id", "event_id").withColumn("metrics", _metrics(
        error_rate=F.col("metrics.error_rate"), total_count=F.col("metrics.total_count"),
        error_count=F.col("metrics.error_count"),
    )))


def volume_events(volume: DataFrame) -> DataFrame:
    """Volume anomalies as anomaly events."""
    return _conform(volume.withColumns({
        "description": F.format_string(
            "Volume %s detected for service %s (Z-Score: %.2f)", F.col("type"), F.col("service_id"),
            F.col("z_score"),
        ),
        "metrics": _metrics(
            z_score=F.col("z_score"), current_volume=F.col("current_volume"), mean_volume=F.col("mean_volume"),
            std_dev=F.col("std_dev"), type=F.col("type"),
        ),
    }))


def all_anomalies(rate: DataFrame, volume: DataFrame) -> DataFrame:
    """Both detectors in one table of anomaly events."""
    return rate_events(rate).unionByName(volume_events(volume))


# --- routing and messages -------------------------------------------------------------------------------

def route_alerts(events: DataFrame) -> DataFrame:
    """HIGH and CRITICAL events; a missing severity is not routed."""
    return events.where(F.upper(F.coalesce("severity", F.lit("UNKNOWN"))).isin("HIGH", "CRITICAL"))


def render_alerts(events: DataFrame, tz: str = "UTC", sender: str = "Log Analytics") -> DataFrame:
    """Subject and body of the alert for every event, signed by ``sender``. Nothing is sent."""
    local = F.from_utc_timestamp("timestamp", tz)
    time = F.coalesce(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit("unknown"))

    def shown(col: str) -> Column:
        return F.coalesce(F.col(col).cast("string"), F.lit("null"))

    return events.select(
        "event_id", "project_id", "service_id",
        F.format_string(C.ALERT_SUBJECT, shown("service_id")).alias("subject"),
        F.format_string(
            C.ALERT_BODY, shown("service_id"), shown("severity"), shown("detector"), shown("project_id"), time,
            F.lit(sender),
        ).alias("body"),
    )


def event_payload(events: DataFrame) -> DataFrame:
    """Add ``payload``, the event as JSON with ISO times."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    m = F.col("metrics")
    payload = F.struct(
        F.col("schema_version").alias("schemaVersion"), F.col("event_type").alias("eventType"),
        F.col("event_id").alias("eventId"), F.col("project_id").alias("projectId"),
        F.col("service_id").alias("serviceId"), F.col("detector"), F.col("severity"),
        F.col("deduplication_key").alias("deduplicationKey"), F.col("description"),
        F.regexp_replace(iso, r"\.?0+Z$", "Z").alias("timestamp"),
        F.when(m.isNotNull(), F.struct(
            m.z_score.alias("zScore"), m.current_volume.alias("currentVolume"),
            m.mean_volume.alias("meanVolume"), m.std_dev.alias("stdDev"), m.type.alias("type"),
            m.error_rate.alias("errorRate"), m.total_count.alias("totalCount"), m.error_count.alias("errorCount"),
        )).alias("metrics"),
    )
    return events.withColumn("payload", F.to_json(payload))


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per event and active subscription of its project; events without project or id are skipped."""
    active = subscriptions.where("active").select(F.col("id").alias("subscription_id"), "project_id")
    usable = events.where(F.col("project_id").isNotNull() & F.col("event_id").isNotNull())
    return join_dim(usable, active, ["project_id"])


def sign_payloads(deliveries: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Add ``signature``, ``sha256=`` and the HMAC of the payload. Key pads are made once per subscription."""
    inner, outer = hmac_pads(F.col("secret"))
    pads = subscriptions.select(
        F.col("id").alias("subscription_id"), F.hex(inner).alias("_inner"), F.hex(outer).alias("_outer")
    )
    signed = join_dim(deliveries, pads, ["subscription_id"]).withColumn(
        "signature",
        F.concat(F.lit("sha256="), hmac_sha256(F.unhex("_inner"), F.unhex("_outer"), F.col("payload"))),
    )
    return signed.drop("_inner", "_outer")


def url_policy(df: DataFrame, url_col: str, resolved: DataFrame | None = None) -> DataFrame:
    """Add ``is_valid`` and ``error``.

    Address rules apply to literal hosts. ``resolved(host, ip)`` adds looked-up addresses: a name is then
    refused if it has no row or if one of its addresses is blocked. No job looks names up itself.
    """
    url = F.col(url_col)
    checked = df.withColumn("error", url_error(url))
    if resolved is not None:
        blocked = resolved.groupBy(F.lower("host").alias("_host")).agg(
            F.min(F.when(is_blocked_address(F.col("ip")), F.col("ip"))).alias("_blocked_ip"),
            F.lit(True).alias("_known"),
        )
        name = F.when(literal_address(url_host(url)).isNull(), F.lower(url_host(url)))
        checked = join_dim(checked.withColumn("_host", name), blocked, ["_host"], "left")
        lookup = (
            F.when(F.col("_host").isNotNull() & F.col("_known").isNull(),
                   F.concat(F.lit(C.URL_UNRESOLVED), F.col("_host")))
            .when(F.col("_blocked_ip").isNotNull(), F.concat(F.lit(C.URL_IP_BLOCKED), F.col("_blocked_ip")))
        )
        checked = checked.withColumn("error", F.coalesce("error", lookup)).drop("_host", "_known", "_blocked_ip")
    return checked.withColumn("is_valid", F.col("error").isNull())
