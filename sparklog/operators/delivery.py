"""The delivery workflow as set-based steps over delivery tables. Nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog import constants as C
from sparklog.functions.clock import instant, shift
from sparklog.functions.keys import stable_id
from sparklog.operators.alerts import event_payload, fan_out
from sparklog.operators.ingest import When
from sparklog.operators.joins import join_dim, top_per_group
from sparklog.schemas import DELIVERIES

PAIR = ["subscription_id", "event_id"]
WAITING = ("PENDING", "RETRY_PENDING")
HISTORY_COLUMNS = (
    "id", "subscription_id", "event_id", "status", "attempts", "http_status", "latency_ms", "next_attempt_at",
    "delivered_at", "last_error", "created_at",
)


# --- enqueue --------------------------------------------------------------------------------------------

def new_deliveries(fanned: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Pairs of subscription and event that do not exist yet, each once."""
    return fanned.dropDuplicates(PAIR).join(deliveries.select(*PAIR), PAIR, "left_anti")


def enqueue_deliveries(
    events: DataFrame, subscriptions: DataFrame, deliveries: DataFrame, as_of: When
) -> DataFrame:
    """New PENDING rows, due now."""
    now = instant(as_of)
    rows = new_deliveries(fan_out(events, subscriptions), deliveries).transform(event_payload).withColumns({
        "id": stable_id(F.col("subscription_id"), F.col("event_id")),
        "status": F.lit("PENDING"), "attempts": F.lit(0), "next_attempt_at": now,
        "created_at": now, "updated_at": now,
    })
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in DELIVERIES.fields
    ])


def due_deliveries(deliveries: DataFrame, as_of: When, k: int = 100) -> DataFrame:
    """Per waiting status, the ``k`` earliest due rows."""
    waiting = deliveries.where(
        F.col("status").isin(*WAITING) & (F.col("next_attempt_at") <= instant(as_of))
    )
    return top_per_group(waiting, ["status"], [F.col("next_attempt_at"), F.col("id")], k)


# --- attempts -------------------------------------------------------------------------------------------

def _first_outcomes(outcomes: DataFrame) -> DataFrame:
    """Per delivery, the ``first`` outcome (unfinished ones last) and their number ``n``, combined before the shuffle."""
    order = F.struct(F.col("finished_at").isNull().alias("_open"), "finished_at", "http_status", "error", "latency_ms", "body")
    return outcomes.groupBy("delivery_id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def ignored_outcomes(deliveries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes that :func:`apply_attempts` does not use: ``delivery_id``, their number ``ignored`` and the ``reason``."""
    known = deliveries.select(F.col("id").alias("delivery_id"), "status", F.lit(True).alias("_known"))
    rows = _first_outcomes(outcomes).join(known, "delivery_id", "left")
    waits = F.coalesce(F.col("status").isin(*WAITING), F.lit(False))
    reason = F.when(F.col("_known").isNull(), "unknown delivery").when(waits, "repeated").otherwise("not waiting")
    return rows.select(
        "delivery_id", F.when(waits, F.col("n") - 1).otherwise(F.col("n")).alias("ignored"), reason.alias("reason")
    ).where("ignored > 0")


def apply_attempts(deliveries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Deliveries after one attempt each: the earliest outcome of every delivery that waits.

    Further outcomes of a delivery, and outcomes of one that is DELIVERED or FAILED, change nothing
    (:func:`ignored_outcomes` counts them).
    2xx delivers. 408, 429, 5xx and errors without a status retry after 30, 120, 600, 1800 s and go to
    the dead letters on the fifth attempt; any other status fails at once. ``dead`` marks the dead
    letters of this step. Rows without an outcome stay as they are.
    """
    tried = _first_outcomes(outcomes).select(
        F.col("delivery_id").alias("id"), F.col("first.http_status").alias("_http"), F.col("first.error").alias("_error"),
        F.col("first.latency_ms").alias("_latency"), F.col("first.body").alias("_body"),
        F.col("first.finished_at").alias("_at"), F.lit(True).alias("_tried"),
    )
    rows = deliveries.join(tried, "id", "left")
    http, attempts = F.col("_http"), F.col("attempts") + 1
    ok = F.coalesce(http.between(200, 299), F.lit(False))
    retry = http.isNull() | http.isin(408, 429) | http.between(500, 599)
    dead = retry & (attempts >= C.MAX_ATTEMPTS)
    body = F.coalesce("_body", F.lit(""))
    error = (
        F.when(ok, None)
        .when(http.isNull(), F.col("_error"))
        .when(retry, F.concat(F.lit("HTTP "), http.cast("string"), F.lit(": "), body))
        .otherwise(F.concat(F.lit("Non-retryable HTTP "), http.cast("string"), F.lit(": "), body))
    )
    delays = F.array(*[F.lit(d) for d in C.RETRY_DELAYS_SECONDS])
    delay = F.element_at(delays, F.least(attempts, F.lit(len(C.RETRY_DELAYS_SECONDS) - 1)) + 1)
    status = F.when(ok, "DELIVERED").when(dead | ~retry, "FAILED").otherwise("RETRY_PENDING")
    waits = retry & ~dead
    after = {
        "status": status,
        "attempts": attempts,
        "http_status": http,
        "latency_ms": F.col("_latency"),
        "next_attempt_at": F.when(waits, shift(F.col("_at"), delay)).otherwise(F.col("next_attempt_at")),
        "delivered_at": F.when(~waits, F.col("_at")).otherwise(F.col("delivered_at")),
        "last_error": error,
        "updated_at": F.col("_at"),
    }
    tried_now = F.coalesce(F.col("_tried") & F.col("status").isin(*WAITING), F.lit(False))
    return rows.select(
        *[(F.when(tried_now, after[c]).otherwise(F.col(c)).cast(deliveries.schema[c].dataType).alias(c)
           if c in after else F.col(c)) for c in deliveries.columns],
        (tried_now & dead).alias("dead"),
    )


def dead_letters(applied: DataFrame) -> DataFrame:
    """Dead-letter rows of one :func:`apply_attempts` step."""
    return applied.where("dead").select(
        "id", "subscription_id", "event_id", "payload", "attempts",
        F.col("http_status").alias("last_http_status"), "last_error",
        F.col("delivered_at").alias("failed_at"), F.col("created_at").alias("original_created_at"),
    )


def replay_deliveries(
    deliveries: DataFrame, subscriptions: DataFrame, requests: DataFrame, as_of: When
) -> tuple[DataFrame, DataFrame]:
    """(updated, refused) for ``requests(delivery_id, project_id)``.

    Rows of the caller's project that are not DELIVERED wait again, due now. A DELIVERED row is refused,
    and so is a row that does not exist or belongs to another project.
    """
    now = instant(as_of)
    owned = project_of_deliveries(deliveries, subscriptions)
    asked = requests.select(F.col("delivery_id").alias("id"), "project_id").dropDuplicates()
    found = asked.join(owned, ["id", "project_id"], "left")
    reason = (
        F.when(F.col("status").isNull(), "Delivery not found or access denied")
        .when(F.col("status") == "DELIVERED", "Cannot replay already delivered webhook")
    )
    judged = found.withColumn("reason", reason)
    updated = judged.where("reason is null").withColumns({
        "status": F.lit("PENDING"), "next_attempt_at": now, "last_error": F.lit(None).cast("string"),
        "attempts": F.lit(0), "updated_at": now,
    })
    refused = judged.where("reason is not null").select(F.col("id").alias("delivery_id"), "project_id", "reason")
    return updated.select(*deliveries.columns), refused


# --- reads ----------------------------------------------------------------------------------------------

def project_of_deliveries(deliveries: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Deliveries with the project of their subscription."""
    owners = subscriptions.select(F.col("id").alias("subscription_id"), "project_id")
    return join_dim(deliveries, owners, ["subscription_id"])


def project_deliveries(deliveries: DataFrame, subscriptions: DataFrame, project_id: int) -> DataFrame:
    """Deliveries of one project."""
    mine = subscriptions.where(F.col("project_id") == project_id)
    return project_of_deliveries(deliveries, mine)


def delivery_history(
    deliveries: DataFrame, subscription_id: int, subscriptions: DataFrame | None = None,
    project_id: int | None = None,
) -> DataFrame:
    """Deliveries of one subscription, newest first, in the columns of the history view.

    With ``subscriptions`` and ``project_id`` the subscription must belong to the project.
    """
    rows = deliveries.where(F.col("subscription_id") == subscription_id)
    if subscriptions is not None:
        rows = project_deliveries(rows, subscriptions, project_id)
    return rows.select(*HISTORY_COLUMNS).orderBy(F.col("created_at").desc(), "id")


def dlq_history(dlq: DataFrame, subscription_id: int) -> DataFrame:
    """Dead letters of one subscription, newest first."""
    return dlq.where(F.col("subscription_id") == subscription_id).orderBy(F.col("failed_at").desc(), "id")


def dlq_since(dlq: DataFrame, when: When) -> DataFrame:
    """Dead letters after an instant."""
    return dlq.where(F.col("failed_at") > instant(when))


def active_subscriptions(subscriptions: DataFrame, project_id: int) -> DataFrame:
    """Active subscriptions of a project; the secret is never selected."""
    return subscriptions.where((F.col("project_id") == project_id) & F.col("active")).select(
        "id", "project_id", "url", "active", "created_at", "updated_at"
    )


def delivery_stats(deliveries: DataFrame, dlq: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """Counters as rows (metric, label, count) with latency mean and max for the results.

    Finished deliveries count as success or failure; dead letters count per subscription only. The facts
    are grouped once; the labels are unfolded from that small result.
    """
    dead = dlq.select(*PAIR).distinct().withColumn("_dead", F.lit(True))
    finished = deliveries.where(F.col("status").isin("DELIVERED", "FAILED")).join(dead, PAIR, "left").where(
        (F.col("status") == "DELIVERED") | F.col("_dead").isNull()
    )
    result = F.when(F.col("status") == "DELIVERED", "success").otherwise("failure")
    cells = finished.groupBy(result.alias("result"), "attempts", "http_status").agg(
        F.count(F.lit(1)).alias("n"), F.count("latency_ms").alias("timed"),
        F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms"),
    )

    def row(metric: str, label: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), label.cast("string").alias("label"))

    unfolded = cells.withColumn("row", F.explode(F.array(
        row("delivery", F.col("result")), row("attempt", F.col("attempts")), row("http_status", F.col("http_status")),
    ))).select("row.*", "n", "timed", "total_ms", "max_ms").where("label is not null")
    totals = unfolded.groupBy("metric", "label").agg(
        F.sum("n").alias("count"), F.sum("timed").alias("timed"), F.sum("total_ms").alias("total_ms"),
        F.max("max_ms").alias("max_ms"),
    ).select(
        "metric", "label", "count",
        F.when(F.col("metric") == "delivery", F.try_divide(F.col("total_ms").cast("double"), F.col("timed")))
        .alias("latency_mean_ms"),
        F.when(F.col("metric") == "delivery", F.col("max_ms")).alias("latency_max_ms"),
    )
    letters = dlq.groupBy(F.col("subscription_id").cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("count")
    ).withColumn("metric", F.lit("dlq"))
    stats = totals.unionByName(letters, allowMissingColumns=True)
    if replayed is not None:
        replays = replayed.agg(F.count(F.lit(1)).alias("count")).withColumns(
            {"metric": F.lit("replay"), "label": F.lit("all")}
        )
        stats = stats.unionByName(replays, allowMissingColumns=True)
    return stats
