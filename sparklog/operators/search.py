"""Search over log documents, the merged console feed, trace roll-ups and annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog import constants as C
from sparklog.functions.clock import instant, instant_text
from sparklog.functions.text import first_line, has_text, has_token, not_blank, preview
from sparklog.operators.ingest import When

DOCUMENT_COLUMNS = (
    "id", "service_id", "level", "project_id", "message", "timestamp", "trace_id", "span_id", "parent_span_id"
)


def to_log_documents(logs: DataFrame, dedup: bool = True) -> DataFrame:
    """The searchable columns, one document per id."""
    docs = logs.select(*DOCUMENT_COLUMNS)
    return docs.dropDuplicates(["id"]) if dedup else docs


# --- filters --------------------------------------------------------------------------------------------

def _in_project(docs: DataFrame, project_id: int) -> DataFrame:
    return docs.where(F.col("project_id") == project_id)


def search_logs(docs: DataFrame, project_id: int, query: str | None = None, mode: str = "substring") -> DataFrame:
    """Keyword search in one project; a blank query gives everything, newest first.

    ``mode="token"`` matches inside single tokens, so a query with a blank is refused.
    """
    rows = _in_project(docs, project_id)
    if query is None or not query.strip():
        return recent_logs(docs, project_id)
    if mode == "token":
        if len(query.split()) > 1:
            raise ValueError("a token query cannot contain blanks")
        return rows.where(has_token(F.col("message"), query.strip()))
    return rows.where(has_text(F.col("message"), query))


def search_by_service(docs: DataFrame, project_id: int, service_id: str) -> DataFrame:
    return _in_project(docs, project_id).where(F.col("service_id") == service_id)


def search_by_level(docs: DataFrame, project_id: int, level: str) -> DataFrame:
    return _in_project(docs, project_id).where(F.col("level") == level)


def search_by_trace(docs: DataFrame, project_id: int, trace_id: str) -> DataFrame:
    """Records of one trace, oldest first."""
    return _in_project(docs, project_id).where(F.col("trace_id") == trace_id).orderBy("timestamp", "id")


def logs_before(docs: DataFrame, when: When) -> DataFrame:
    return docs.where(F.col("timestamp") < instant(when))


def recent_logs(docs: DataFrame, project_id: int, limit: int | None = None) -> DataFrame:
    """Newest first. A limit becomes a top-k per task, without a full sort."""
    rows = _in_project(docs, project_id).orderBy(F.col("timestamp").desc(), "id")
    return rows if limit is None else rows.limit(limit)


def list_services(docs: DataFrame, project_id: int) -> DataFrame:
    return _in_project(docs, project_id).select("service_id").distinct()


# --- console feed ---------------------------------------------------------------------------------------

def anomalies_as_logs(volume: DataFrame) -> DataFrame:
    """Volume anomalies in the shape of log documents, level ANOMALY."""
    label = F.when(F.col("type") == "SPIKE", C.SPIKE_LABEL).otherwise(C.DROP_LABEL)
    return volume.select(
        F.concat_ws("-", F.lit("anomaly"), instant_text(F.col("timestamp")), "service_id").alias("id"),
        "service_id",
        F.lit("ANOMALY").alias("level"),
        "project_id",
        F.format_string(
            C.INSIGHT, label, F.coalesce("z_score", F.lit(0.0)), F.col("current_volume"),
            F.coalesce("mean_volume", F.lit(0.0)),
        ).alias("message"),
        "timestamp",
    )


def console_feed(
    docs: DataFrame, volume: DataFrame, order: bool = True, project_id: int | None = None, limit: int | None = None,
) -> DataFrame:
    """Log documents and anomaly rows, newest first, rows without a time last.

    A project is filtered below the union; a limit becomes a top-k per task, without a full sort.
    """
    if project_id is not None:
        docs, volume = _in_project(docs, project_id), _in_project(volume, project_id)
    feed = docs.select(*DOCUMENT_COLUMNS).unionByName(anomalies_as_logs(volume), allowMissingColumns=True)
    rows = feed.orderBy(F.col("timestamp").desc_nulls_last(), "id") if order else feed
    return rows if limit is None else rows.limit(limit)


def console_filter(feed: DataFrame, query: str = "", service: str = "ALL", level: str = "ALL") -> DataFrame:
    """Text in message or service id, then service, then level; ``ALL`` means no filter."""
    if query:
        empty = F.lit("")
        feed = feed.where(
            has_text(F.coalesce("message", empty), query) | has_text(F.coalesce("service_id", empty), query)
        )
    if service != "ALL":
        feed = feed.where(F.col("service_id") == service)
    if level != "ALL":
        feed = feed.where(F.col("level") == level)
    return feed


def feed_services(feed: DataFrame) -> DataFrame:
    """``ALL`` and the distinct non-empty services."""
    everything = feed.sparkSession.range(1).select(F.lit("ALL").alias("service_id"))
    return everything.unionByName(feed.select("service_id").where("service_id <> ''").distinct())


# --- traces ---------------------------------------------------------------------------------------------

def _has_trace() -> Column:
    return F.coalesce(F.col("trace_id") != "", F.lit(False))


def trace_groups(docs: DataFrame) -> DataFrame:
    """Records that share a trace as one row; records without a trace stay on their own.

    Aggregates combine before the shuffle, so one trace may hold any share of the rows.
    """
    newest = F.struct(-F.unix_micros("timestamp"), F.col("id"))
    level = (
        F.when(F.bool_or(F.col("level") == "ERROR"), "ERROR")
        .when(F.bool_or(F.col("level") == "WARN"), "WARN")
        .otherwise(F.min_by("level", newest))
    )
    groups = docs.where(_has_trace()).groupBy("project_id", "trace_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.max("timestamp").alias("timestamp"),
        F.min_by("service_id", newest).alias("service_id"),
        level.alias("level"),
    ).withColumns({"kind": F.lit("group"), "id": F.lit(None).cast("string")})
    single = docs.where(~_has_trace()).select(
        "project_id", F.lit(None).cast("string").alias("trace_id"), F.lit(1).cast("bigint").alias("records"),
        "timestamp", "service_id", "level", F.lit("standalone").alias("kind"), "id",
    )
    return groups.unionByName(single)


def trace_preview(docs: DataFrame, width: int = 90) -> DataFrame:
    """The record that stands for each trace: newest ERROR, else newest WARN, else the oldest one."""
    micros = F.unix_micros("timestamp")
    rank = F.when(F.col("level") == "ERROR", 0).when(F.col("level") == "WARN", 1).otherwise(2)
    order = F.struct(rank, F.when(rank < 2, -micros).otherwise(micros), F.col("id"))
    primary = F.min_by(F.struct("id", "level", "message"), order).alias("_primary")
    return docs.where(_has_trace()).groupBy("project_id", "trace_id").agg(primary).select(
        "project_id", "trace_id", F.col("_primary.id").alias("id"), F.col("_primary.level").alias("level"),
        preview(F.col("_primary.message"), width).alias("preview"),
    )


# --- annotation -----------------------------------------------------------------------------------------

def annotate_logs(docs: DataFrame) -> DataFrame:
    """Action and user of INFO rows, cause and fix of ERROR and WARN rows, stack traces of all rows."""
    message = F.coalesce("message", F.lit(""))
    level = F.coalesce("level", F.lit("INFO"))
    info, faulty = level == "INFO", level.isin("ERROR", "WARN")
    login = info & message.rlike(C.LOGIN_PATTERN)
    order = info & message.rlike(C.ORDER_PATTERN)
    stack = F.contains(message, F.lit(C.STACK_TRACE_MARKS[0]))
    for mark in C.STACK_TRACE_MARKS[1:]:
        stack = stack | F.contains(message, F.lit(mark))

    def matches(every: tuple[str, ...], some: tuple[str, ...]) -> Column:
        hit = F.lit(not some)
        for word in some:
            hit = hit | has_text(message, word)
        for word in every:
            hit = hit & has_text(message, word)
        return hit

    cause, fix = F.when(~faulty, None), F.when(~faulty, None)
    for every, some, text, advice, _ in C.CAUSE_RULES:
        cause = cause.when(matches(every, some), text)
        fix = fix.when(matches(every, some), advice)
    cause = cause.otherwise(C.DEFAULT_CAUSE).cast("string")
    ignorable = [text for _, _, text, _, ignore in C.CAUSE_RULES if ignore]
    return docs.withColumns({
        "action": F.when(order, C.ORDER_ACTION).when(login, C.LOGIN_ACTION),
        "user": F.when(login, F.regexp_extract(message, C.LOGIN_PATTERN, 1)),
        "root_cause": cause,
        "suggested_fix": fix.otherwise(C.DEFAULT_FIX).cast("string"),
        "is_ignorable": F.coalesce(cause.isin(*ignorable), F.lit(False)),
        "extracted_message": F.when(
            order, F.format_string(C.ORDER_TEXT, F.regexp_extract(message, C.ORDER_PATTERN, 1))
        ).when(login, C.LOGIN_TEXT).when(stack, first_line(message)).otherwise(message),
        "has_stack_trace": stack,
    })


def diagnose_anomalies(volume: DataFrame) -> DataFrame:
    """Root cause and advice for every volume anomaly."""
    drop = F.col("type") == "DROP"
    mean = F.coalesce("mean_volume", F.lit(0.0))

    def cause(template: str) -> Column:
        return F.format_string(template, F.col("service_id"), mean, F.col("current_volume"))

    def fix(template: str) -> Column:
        return F.replace(F.lit(template), F.lit("{s}"), F.col("service_id"))

    return volume.withColumns({
        "root_cause": F.when(drop, cause(C.DROP_CAUSE)).otherwise(cause(C.SPIKE_CAUSE)),
        "suggested_fix": F.when(drop, fix(C.DROP_FIX)).otherwise(fix(C.SPIKE_FIX)),
    })
