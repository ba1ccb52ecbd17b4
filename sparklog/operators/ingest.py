"""Raw records to clean log entries: validate, resolve the tenant, parse, redact."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog import constants as C
from sparklog.functions.clock import instant, iso_instant, parse_event_time
from sparklog.functions.keys import hash_api_key, stable_id
from sparklog.functions.levels import known_level
from sparklog.functions.text import not_blank, redact
from sparklog.operators.joins import join_dim

When = Column | str | dt.datetime

TRACEPARENT = (
    r"\A[\x00-\x20]*00-([0-9a-f]{32})-(?!0{16}-)([0-9a-f]{16})-[0-9a-f]{2}-*[\x00-\x20]*\z"
)


# --- validation -----------------------------------------------------------------------------------------

def with_errors(raw: DataFrame) -> DataFrame:
    """Add ``errors``, a map of field to message; empty for a valid record."""
    checks = F.create_map(
        F.lit("message"), F.when(~not_blank(F.col("message")), F.lit(C.MSG_BLANK)),
        F.lit("serviceId"), F.when(~not_blank(F.col("service_id")), F.lit(C.SERVICE_BLANK)),
        F.lit("format"), F.when(F.col("format").isNull(), F.lit(C.FORMAT_MISSING)),
    )
    return raw.withColumn("errors", F.map_filter(checks, lambda _, text: text.isNotNull()))


def is_valid() -> Column:
    """Message and service id are not blank and the format is given."""
    return not_blank(F.col("message")) & not_blank(F.col("service_id")) & F.col("format").isNotNull()


def validate_raw(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): together they are the input; invalid rows carry the ``errors`` map."""
    return raw.where(is_valid()), with_errors(raw.where(~is_valid()))


# --- tenancy --------------------------------------------------------------------------------------------

def _active_keys(projects: DataFrame) -> DataFrame:
    return projects.where("api_key_active").select(
        F.col("api_key_hash").alias("_key_hash"), F.col("id").alias("_project")
    )


def _with_key_hash(raw: DataFrame) -> DataFrame:
    key = F.col("api_key")
    return raw.withColumn("_key_hash", F.when(not_blank(key), hash_api_key(key)))


def resolve_tenant(raw: DataFrame, projects: DataFrame) -> DataFrame:
    """Keep the rows with a valid key; ``project_id`` comes from the key, never from the record."""
    joined = join_dim(_with_key_hash(raw), _active_keys(projects), ["_key_hash"])
    return joined.withColumn("project_id", F.col("_project")).drop("_key_hash", "_project")


def unauthorized(raw: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows with no key, a blank one, an unknown one or a revoked one."""
    return join_dim(_with_key_hash(raw), _active_keys(projects), ["_key_hash"], "left_anti").drop("_key_hash")


def _with_record_id(raw: DataFrame) -> DataFrame:
    """Id of a raw row: a hash of its ``record_id``; a row without one gets a new id, whatever it holds."""
    if "_id" in raw.columns:
        return raw
    if "record_id" not in raw.columns:
        return raw.withColumn("_id", F.expr("uuid()"))
    given = F.col("record_id")
    return raw.withColumn("_id", F.when(given.isNotNull(), stable_id(given)).otherwise(F.expr("uuid()")))


def _classified(raw: DataFrame, projects: DataFrame) -> DataFrame:
    """One pass over the raw rows: stable id, tenant (null if none) and validity."""
    rows = _with_key_hash(_with_record_id(raw))
    joined = join_dim(rows, _active_keys(projects), ["_key_hash"], "left")
    return joined.withColumn("_valid", is_valid()).drop("_key_hash")


def _accepted() -> Column:
    return F.col("_valid") & F.col("_project").isNotNull()


# --- parsing --------------------------------------------------------------------------------------------

def parse_traceparent(raw: DataFrame) -> DataFrame:
    """A valid W3C header overrides trace id and parent span; any other header changes nothing."""
    header, found = F.col("traceparent"), F.col("_found")
    rows = raw.withColumn("_found", F.regexp_extract(header, TRACEPARENT, 1))
    return rows.withColumns({
        "trace_id": F.when(found != "", found).otherwise(F.col("trace_id")),
        "parent_span_id": F.when(found != "", F.regexp_extract(header, TRACEPARENT, 2))
        .otherwise(F.col("parent_span_id")),
    }).drop("_found")


def _with_json_text(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Scalar fields of ``_doc`` as text columns; null if missing or null, empty for an object or array.

    Two projections, so that every field is read once and only texts that look like a container are
    looked at again.
    """
    doc = F.col("_doc")
    texts = df.withColumns({c: F.try_variant_get(doc, f"$.{key}", "string") for c, key in fields.items()})

    def scalar(c: str, key: str) -> Column:
        text = F.col(c)
        kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))
        nested = (text.startswith("{") | text.startswith("[")) & (kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        return F.when(nested, F.lit("")).otherwise(text)

    return texts.withColumns({c: scalar(c, key) for c, key in fields.items()})


def parse_logs(raw: DataFrame, as_of: When, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Log entries from validated raw rows, by one chain of projections (no split, no union).

    JSON records give their own fields; a JSON record that does not parse falls back to the fields of
    the request; every other format keeps the text, with no level and the ingest time. Plain records
    keep the trace ids of the request; ``strict=True`` drops them.

    The id is a hash of ``record_id``, which the readers fill from the place in the source; records
    without one get a random id that the write of the result fixes. ``keep`` names further columns to carry along.
    """
    now = instant(as_of)
    is_json = (F.col("format") == "JSON") | (
        (F.col("format") == "AUTO_DETECT") & F.col("message").rlike(r"\A[\x00-\x20]*\{")
    )
    docs = _with_record_id(raw).withColumns({
        "_json": is_json, "_doc": F.when(is_json, F.try_parse_json(F.col("message"))),
    })
    fields = _with_json_text(docs, {
        "_message": "message", "_level": "level", "_time": "timestamp", "_trace": "traceId", "_trace2": "trace_id",
        "_span": "spanId", "_span2": "span_id",
    }).withColumn("_parsed", F.col("_json") & F.col("_doc").isNotNull())
    parsed, is_json = F.col("_parsed"), F.col("_json")
    keeps_trace = is_json if strict else F.lit(True)
    return fields.select(
        F.col("_id").alias("id"),
        F.when(parsed, F.coalesce(iso_instant(F.col("_time")), now))
        .when(is_json, F.coalesce(iso_instant(F.col("timestamp")), now))
        .otherwise(now).alias("timestamp"),
        "service_id",
        F.when(parsed, known_level(F.col("_level"))).when(is_json, known_level(F.col("level"))).alias("level"),
        F.coalesce(F.when(parsed, F.col("_message")), F.col("message")).alias("message"),
        "host",
        F.lit(None).cast("map<string,string>").alias("metadata"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.col("message").alias("raw_log"),
        now.alias("ingestion_timestamp"),
        "project_id",
        F.when(keeps_trace, F.coalesce("_trace", "_trace2", "trace_id")).alias("trace_id"),
        F.when(keeps_trace, F.coalesce("_span", "_span2", "span_id")).alias("span_id"),
        F.when(keeps_trace, F.col("parent_span_id")).alias("parent_span_id"),
        *keep,
    )


def redact_pii(df: DataFrame, cols: tuple[str, ...] = ("message", "raw_log")) -> DataFrame:
    """Redact personal data in the named text columns."""
    return df.withColumns({c: redact(F.col(c)) for c in cols})


#: How the text of an error row begins.
FAILED = "Failed processing log: "


# --- the ingest job -------------------------------------------------------------------------------------

def ingest_outcomes(raw: DataFrame, projects: DataFrame, as_of: When, strict: bool = False) -> DataFrame:
    """Every raw row once, with ``outcome`` ``logs`` or ``errors`` and, for the latter, ``error_id`` and ``error``.

    Written with ``write_outcomes`` it fills both sinks in one pass over the raw rows. With a small
    project table nothing is shuffled.
    """
    rows = _classified(raw, projects)
    outcome = F.when(_accepted(), "logs").otherwise("errors")
    failed = with_errors(rows).withColumns({
        "outcome": outcome, "error_id": F.when(~_accepted(), _error_id(rows)),
        "error": F.when(~_accepted(), _error_text()), "project_id": F.col("_project"),
    }).withColumn("message", F.when(F.col("outcome") == "logs", F.col("message")))  # a failed row is not parsed
    entries = parse_logs(parse_traceparent(failed), as_of, strict, keep=("outcome", "error_id", "error"))
    return redact_pii(entries)


def ingest(
    raw: DataFrame, projects: DataFrame, as_of: When, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(logs, errors), each as its own narrow plan."""
    return split_outcomes(ingest_outcomes(raw, projects, as_of, strict))


def split_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logs, errors) of an outcome table."""
    logs = outcomes.where(F.col("outcome") == "logs").drop("outcome", "error_id", "error")
    errors = outcomes.where(F.col("outcome") == "errors")
    return logs, errors.select(F.col("error_id").alias("id"), F.col("error").alias("message"))


def _error_id(rows: DataFrame) -> Column:
    return F.coalesce(F.col("record_id"), F.lit("unknown")) if "record_id" in rows.columns else F.lit("unknown")


def _error_text() -> Column:
    """Reason and redacted raw text of a failed row with its ``errors`` map."""
    reason = F.when(
        ~F.col("_valid"), F.concat(F.lit(C.VALIDATION_TEXT + ": "), F.array_join(F.map_values("errors"), "; "))
    ).otherwise(F.lit(C.UNAUTHORIZED_TEXT))
    return F.concat(
        F.lit(FAILED), reason, F.lit(" | Raw: "), redact(F.coalesce(F.col("message"), F.lit("null")))
    )


def ingest_errors(raw: DataFrame, projects: DataFrame) -> DataFrame:
    """Error rows ``(id or "unknown", text)``."""
    rows = _classified(raw, projects)
    failed = with_errors(rows.where(~_accepted()))
    return failed.select(_error_id(rows).alias("id"), _error_text().alias("message"))


def ingest_status(raw: DataFrame, projects: DataFrame, as_of: When) -> DataFrame:
    """One response row per record. The id is that of the log only if the record has a ``record_id``; a sender
    without one is answered from the stored outcomes (:func:`outcome_status`)."""
    return _classified(raw, projects).select(
        F.when(_accepted(), F.col("_id")).alias("id"),
        F.when(_accepted(), C.ACCEPTED).otherwise(C.ERROR).alias("status"),
        F.when(_accepted(), C.ACCEPTED_TEXT).when(~F.col("_valid"), C.VALIDATION_TEXT)
        .otherwise(C.UNAUTHORIZED_TEXT).alias("message"),
        instant(as_of).alias("timestamp"),
    )


def outcome_status(outcomes: DataFrame) -> DataFrame:
    """One response row per row of an outcome table, with the ids under which the logs are stored."""
    ok = F.col("outcome") == "logs"
    invalid = F.col("error").startswith(f"{FAILED}{C.VALIDATION_TEXT}:")
    return outcomes.select(
        F.when(ok, F.col("id")).alias("id"),
        F.when(ok, C.ACCEPTED).otherwise(C.ERROR).alias("status"),
        F.when(ok, C.ACCEPTED_TEXT).when(invalid, C.VALIDATION_TEXT).otherwise(C.UNAUTHORIZED_TEXT).alias("message"),
        F.col("ingestion_timestamp").alias("timestamp"),
    )


def ingest_stats(outcomes: DataFrame) -> DataFrame:
    """Accepted and failed records of an outcome table, and the delay from event to ingest over the accepted ones."""
    ok = F.col("outcome") == "logs"
    delay = ((F.unix_micros("ingestion_timestamp") - F.unix_micros("timestamp")) / 1000).cast("bigint")
    sums = outcomes.agg(
        F.count_if(ok).alias("logs"), F.count_if(~ok).alias("errors"),
        F.sum(F.when(ok, delay)).alias("total"), F.max(F.when(ok, delay)).alias("most"),
    )
    return sums.selectExpr(
        "stack(2, 'ingested', logs, total, most, 'errors', errors, null, null) "
        "as (metric, count, total_delay_ms, max_delay_ms)"
    )


# --- decoding of published events -----------------------------------------------------------------------

def decode_log_events(df: DataFrame, col: str, as_of: When) -> tuple[DataFrame, DataFrame]:
    """(events, bad) from JSON text: missing text is empty, missing ids are null, broken JSON is bad."""
    docs = df.withColumn("_doc", F.try_parse_json(F.col(col)))
    fields = _with_json_text(docs.where(F.col("_doc").isNotNull()), {
        "_id": "id", "_time": "timestamp", "_service": "serviceId", "_level": "level", "_message": "message",
        "_trace": "traceId", "_span": "spanId", "_parent": "parentSpanId",
    })

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    events = fields.select(
        F.coalesce("_id", stable_id(F.col(col))).alias("id"),
        parse_event_time(F.col("_time"), instant(as_of)).alias("timestamp"),
        text("_service").alias("service_id"),
        text("_level").alias("level"),
        text("_message").alias("message"),
        F.try_variant_get("_doc", "$.projectId", "bigint").alias("project_id"),
        F.col("_trace").alias("trace_id"),
        F.col("_span").alias("span_id"),
        F.col("_parent").alias("parent_span_id"),
    )
    bad = docs.where(F.col("_doc").isNull()).select(
        F.lit("unknown").alias("id"),
        F.concat(F.lit("Failed to parse log message: "), F.coalesce(F.col(col), F.lit("null"))).alias("message"),
    )
    return events, bad
