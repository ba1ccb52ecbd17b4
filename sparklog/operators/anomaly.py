"""Error-rate and volume detectors, suppression of repeats, recent anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparklog import constants as C
from sparklog.functions.clock import bucket_start, instant, shift, width_seconds
from sparklog.functions.keys import dedup_key, stable_id
from sparklog.functions.levels import is_error, is_warning
from sparklog.operators.ingest import When
from sparklog.operators.joins import top_per_group
from sparklog.session import scratch_dir

#: Time slots per silence in which the next anomaly of a key is looked for.
SLOTS = 96
# Sums of squares outgrow 64 bits; the z-score rules are decided on exact integers.
WIDE = T.DecimalType(38, 0)


# --- error rate -----------------------------------------------------------------------------------------

def error_rate_windows(
    logs: DataFrame,
    width: str = "1 minute",
    keys: tuple[str, ...] = ("project_id", "service_id"),
    time_col: str = "timestamp",
) -> DataFrame:
    """Counts and error rate per key and tumbling window; the same plan runs on a stream.

    ``keys=("service_id",)`` mixes the projects that share a service name and reports the project of the
    newest record.
    """
    aggs = [
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(is_error(F.col("level"))).alias("error_count"),
        F.count_if(is_warning(F.col("level"))).alias("warning_count"),
    ]
    if "project_id" not in keys:
        aggs.append(F.max_by("project_id", time_col).alias("project_id"))
    return _rates(logs.groupBy(*keys, F.window(time_col, width).alias("_window")).agg(*aggs))


def windows_of(counted: DataFrame, width: str = "1 minute") -> DataFrame:
    """:func:`error_rate_windows` from counters (``metrics.counters``) of a width that divides ``width``."""
    return _rates(counted.groupBy("project_id", "service_id", F.window("bucket", width).alias("_window")).agg(
        F.sum("total").alias("total_count"), F.sum("error").alias("error_count"), F.sum("warn").alias("warning_count")))


def _rates(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "project_id", "service_id",
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"),
        "total_count", "error_count", "warning_count",
        F.coalesce(F.try_divide(F.col("error_count").cast("double"), F.col("total_count")), F.lit(0.0))
        .alias("error_rate"),
    )


def error_rate_anomalies(
    windows: DataFrame, high: float = 0.10, medium: float = 0.05, spike: int = 1000
) -> DataFrame:
    """CRITICAL above ``high``, HIGH above ``medium``, MEDIUM for more than ``spike`` rows; all strict."""
    rate, total = F.col("error_rate"), F.col("total_count")

    def pick(critical: str, elevated: str, volume: str) -> Column:
        return F.when(rate > high, critical).when(rate > medium, elevated).when(total > spike, volume)

    key = dedup_key(F.col("project_id"), F.col("service_id"), "error-rate", F.col("window_end"))
    return windows.withColumn("severity", pick("CRITICAL", "HIGH", "MEDIUM")).where("severity is not null").select(
        stable_id(key).alias("id"),
        F.lit(C.SCHEMA_VERSION).alias("schema_version"),
        F.lit(C.ANOMALY_EVENT_TYPE).alias("event_type"),
        "project_id", "service_id",
        F.lit(C.ERROR_RATE_DETECTOR).alias("detector"),
        "severity",
        key.alias("deduplication_key"),
        pick(C.HIGH_RATE_TEXT, C.MEDIUM_RATE_TEXT, C.SPIKE_TEXT).alias("description"),
        F.col("window_end").alias("timestamp"),
        F.struct("error_rate", "total_count", "error_count").alias("metrics"),
    )


# --- volume z-score -------------------------------------------------------------------------------------

def _moments(k: Column, s: Column, q: Column) -> dict[str, Column]:
    """Mean and population deviation from count, sum and sum of squares."""
    spread = k.cast(WIDE) * q - s.cast(WIDE) * s.cast(WIDE)
    return {
        "points": k,
        "mean_volume": s.cast("double") / k,
        "std_dev": F.sqrt(spread.cast("double")) / k,
        "_spread": spread,
    }


def _square(col: Column) -> Column:
    return (col.cast("decimal(19,0)") * col.cast("decimal(19,0)")).cast(WIDE)


def volume_baseline(
    counts: DataFrame, as_of: When, width: str = "1 minute", lookback: str = "24 hours"
) -> DataFrame:
    """Count, mean and population deviation over the present buckets up to the last complete one."""
    return _baseline(counts, as_of, width, lookback).drop("_spread", "_sum", "current_volume")


def _baseline(counts: DataFrame, as_of: When, width: str, lookback: str) -> DataFrame:
    current = shift(bucket_start(instant(as_of), width), -width_seconds(width))
    first = shift(current, -width_seconds(lookback))
    sums = counts.where(F.col("bucket").between(first, current)).groupBy("project_id", "service_id").agg(
        F.count(F.lit(1)).alias("_k"),
        F.sum("total").alias("_sum"),
        F.sum(_square(F.col("total"))).alias("_q"),
        F.coalesce(F.max(F.when(F.col("bucket") == current, F.col("total"))), F.lit(0)).alias("current_volume"),
    )
    return sums.withColumns(_moments(F.col("_k"), F.col("_sum"), F.col("_q"))).drop("_k", "_q")


def _score(stats: DataFrame, min_points: int, min_drop_mean: float) -> DataFrame:
    """Apply the z rules to rows with points, _sum, _spread, current_volume and the moments.

    With k points, sum S, squares Q and volume n: z > 3 means k*n - S > 0 and (k*n - S)^2 > 9 (k*Q - S^2).
    """
    k, spread, n = F.col("points").cast(WIDE), F.col("_spread"), F.col("current_volume")
    diff = k * n.cast(WIDE) - F.col("_sum").cast(WIDE)
    flat = spread == 0
    beyond = {t: F.when(flat, diff > 0).otherwise(diff * diff > F.lit(t * t).cast(WIDE) * spread) for t in (3, 5)}
    z = (
        F.when(~flat, diff.cast("double") / F.sqrt(spread.cast("double")))
        .when(diff > 0, F.lit(10.0))
        .otherwise(F.lit(0.0))
    )
    kind = F.when(diff > 0, "SPIKE").otherwise("DROP")
    scored = stats.where(F.col("points") >= min_points).where(beyond[3]).withColumns({
        "z_score": z, "type": kind, "severity": F.when(beyond[5], "CRITICAL").otherwise("HIGH"),
    })
    return scored.where((F.col("type") == "SPIKE") | (F.col("mean_volume") >= min_drop_mean))


def _volume_events(scored: DataFrame) -> DataFrame:
    key = dedup_key(F.col("project_id"), F.col("service_id"), "volume", F.col("timestamp"))
    return scored.select(
        F.lit(C.SCHEMA_VERSION).alias("schema_version"),
        F.lit(C.ANOMALY_EVENT_TYPE).alias("event_type"),
        stable_id(key).alias("event_id"),
        "project_id", "service_id",
        F.lit(C.VOLUME_DETECTOR).alias("detector"),
        "severity",
        key.alias("deduplication_key"),
        "timestamp", "z_score", "current_volume", "mean_volume", "std_dev", "type",
    )


def volume_events(stats: DataFrame, min_points: int = 10, min_drop_mean: float = 5.0) -> DataFrame:
    """The anomalies among rows that hold a bucket's ``current_volume`` and ``points``, ``total`` and ``squares`` of its look-back."""
    named = stats.withColumn("_sum", F.col("total"))
    moments = _moments(F.col("points"), F.col("_sum"), F.col("squares").cast(WIDE))
    return _volume_events(_score(named.withColumns(moments), min_points, min_drop_mean))


def volume_anomalies(
    counts: DataFrame,
    as_of: When,
    width: str = "1 minute",
    lookback: str = "24 hours",
    min_points: int = 10,
    min_drop_mean: float = 5.0,
) -> DataFrame:
    """Volume anomalies of the last complete bucket, for every (project, service) in one aggregation."""
    current = shift(bucket_start(instant(as_of), width), -width_seconds(width))
    stats = _baseline(counts, as_of, width, lookback)
    return _volume_events(_score(stats, min_points, min_drop_mean).withColumn("timestamp", current))


def volume_anomalies_backfill(
    counts: DataFrame,
    as_of: When,
    since: When | None = None,
    width: str = "1 minute",
    lookback: str = "24 hours",
    min_points: int = 10,
    min_drop_mean: float = 5.0,
    chunk_lookbacks: int = 7,
) -> DataFrame:
    """The volume detector at every bucket after ``since`` up to the last complete one before ``as_of``.

    Works on bucket rows, not on log rows. Each series is cut into time chunks of ``chunk_lookbacks``
    look-backs, and the buckets that a chunk still looks back on are repeated in it, so a series of any
    length spreads over many tasks and the result does not depend on the cut. Inside a chunk the silent
    buckets within one look-back of a present one are filled in; then every look-back is a difference of
    two running sums a fixed number of rows apart: one sort, constant work per row.
    """
    step, span = width_seconds(width), width_seconds(lookback)
    rows_back = span // step + 1
    chunk_len = span * chunk_lookbacks
    last = shift(bucket_start(instant(as_of), width), -step)
    used = counts.where(F.col("bucket") <= last)
    first = None
    if since is not None:
        first = bucket_start(instant(since), width)
        used = used.where(F.col("bucket") > shift(first, -span))

    at = F.unix_seconds("bucket")
    own = F.floor(at / F.lit(chunk_len)).cast("bigint")
    halo = F.floor((at + span) / F.lit(chunk_len)).cast("bigint")
    points = used.select(
        "project_id", "service_id", at.alias("_at"), "total",
        F.explode(F.array_distinct(F.array(own, halo))).alias("_chunk"),
    )
    by_time = Window.partitionBy("project_id", "service_id", "_chunk").orderBy("_at")
    chunk_end = (F.col("_chunk") + 1) * chunk_len - step
    fill_to = F.least(
        F.coalesce(F.lead("_at").over(by_time) - step, chunk_end),
        F.col("_at") + span, chunk_end, F.unix_seconds(last),
    )
    dense = (
        points.withColumn("_fill_to", fill_to)
        .withColumn("_tick", F.explode(F.sequence("_at", "_fill_to", F.lit(step).cast("bigint"))))
        .select(
            "project_id", "service_id", "_chunk", F.col("_tick").alias("_at"),
            (F.col("_tick") == F.col("_at")).alias("_present"), "total",
        )
    )
    zero = F.lit(0)
    volume = F.when(F.col("_present"), F.col("total")).otherwise(zero).cast("bigint")
    running = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dense.withColumn("current_volume", volume).withColumns({
        "_k": F.sum(F.col("_present").cast("bigint")).over(running),
        "_s": F.sum("current_volume").over(running),
        "_q": F.sum(_square(F.col("current_volume"))).over(running),
    })

    def in_lookback(name: str) -> Column:
        return F.col(name) - F.coalesce(F.lag(name, rows_back).over(by_time), zero)

    stats = sums.withColumns({"_k2": in_lookback("_k"), "_sum": in_lookback("_s"), "_q2": in_lookback("_q")})
    evaluated = stats.where((F.col("_at") >= F.col("_chunk") * chunk_len) & (F.col("_k2") > 0))
    if first is not None:
        evaluated = evaluated.where(F.col("_at") > F.unix_seconds(first))
    moments = _moments(F.col("_k2"), F.col("_sum"), F.col("_q2").cast(WIDE))
    scored = _score(evaluated.withColumns(moments), min_points, min_drop_mean)
    return _volume_events(scored.withColumn("timestamp", F.timestamp_seconds("_at")))


# --- the anomaly table ----------------------------------------------------------------------------------

def dedup_anomalies(anomalies: DataFrame, window: str | None = None) -> DataFrame:
    """First anomaly of every deduplication key: a combinable aggregate, so a hot key stays cheap.

    With ``window`` (for example ``"24 hours"``) a kept anomaly silences its key for that long only, and the next one after it is kept.
    """
    if window is not None:
        return _suppressed(anomalies, width_seconds(window) * 1_000_000)
    id_col = "event_id" if "event_id" in anomalies.columns else "id"
    rest = [c for c in anomalies.columns if c not in ("timestamp", id_col, "deduplication_key")]
    first = F.min_by(F.struct("timestamp", id_col, *rest), F.struct("timestamp", id_col)).alias("_first")
    return anomalies.groupBy("deduplication_key").agg(first).select(
        *[F.col("deduplication_key") if c == "deduplication_key" else F.col(f"_first.{c}").alias(c)
          for c in anomalies.columns]
    )


def _next_after(ticks: DataFrame, window: int) -> DataFrame:
    """Per tick (``_key``, ``_us``), the first tick ``_to`` of its key that is at least ``window`` later; ticks without one are left out.

    A key is cut into SLOTS time slots a window. A probe at ``_us + window`` meets the ticks of its own slot in one sorted pass; if none
    is left there, the next slot that has ticks answers with its first. So no task needs all ticks of a key, only all its slots.
    """
    def slot(at: Column) -> Column:
        return F.floor(at / F.lit(max(1, window // SLOTS)))

    def no(name: str) -> Column:
        return F.lit(None).cast("long").alias(name)

    points = ticks.select("_key", F.col("_us").alias("_at"), F.col("_us").alias("_tick"), no("_from"))
    probes = ticks.select("_key", (F.col("_us") + window).alias("_at"), no("_tick"), F.col("_us").alias("_from"))
    both = points.unionByName(probes).withColumn("_slot", slot(F.col("_at")))
    later = Window.partitionBy("_key", "_slot").orderBy(F.desc("_at"), F.col("_tick").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_to", F.last("_tick", ignorenulls=True).over(later)).where(F.col("_from").isNotNull())
    after = Window.partitionBy("_key").orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = both.groupBy("_key", "_slot").agg(F.min("_tick").alias("_first")).withColumn(
        "_next", F.last("_first", ignorenulls=True).over(after)).select("_key", "_slot", "_next")
    found = here.join(slots, ["_key", "_slot"]).select("_key", F.col("_from").alias("_us"), F.coalesce("_to", "_next").alias("_to"))
    return found.where(F.col("_to").isNotNull())


def _suppressed(anomalies: DataFrame, window: int) -> DataFrame:
    """The anomalies that a key's silence of ``window`` microseconds lets through.

    Each kept anomaly points to the next one that is kept. The chain of a key is followed by pointer doubling: hops of 1, 2, 4 ...
    anomalies are built by joining the pointers with themselves, and the chain is filled in from the longest hop down, so a year of days takes nine
    rounds and no key sits in one task. Of equal times the smallest id counts. Anomalies without a time are all kept.
    """
    spark, id_col = anomalies.sparkSession, "event_id" if "event_id" in anomalies.columns else "id"
    root = scratch_dir(spark, "suppression")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{root}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{root}/{name}")

    key = F.coalesce(F.concat(F.lit("="), F.col("deduplication_key").cast("string")), F.lit("")).alias("_key")
    rows = anomalies.withColumns({"_key": key, "_us": F.unix_micros("timestamp")})
    timed = rows.where(F.col("_us").isNotNull())
    own = F.struct(*[F.col(f"`{c}`") for c in anomalies.columns])
    ticks = stored(timed.groupBy("_key", "_us").agg(F.min_by(own, id_col).alias("_row")), "ticks")
    kept = stored(ticks.groupBy("_key").agg(F.min("_us").alias("_us")), "kept")
    first, last = ticks.agg(F.min("_us"), F.max("_us")).first()
    rounds = 0 if first is None else int((last - first) // window).bit_length()
    hops = []
    for n in range(rounds):
        hop = _next_after(ticks.select("_key", "_us"), window) if n == 0 else hops[-1].join(
            hops[-1].select("_key", F.col("_us").alias("_to"), F.col("_to").alias("_then")), ["_key", "_to"]).select(
            "_key", "_us", F.col("_then").alias("_to"))
        hops.append(stored(hop, f"hop-{n}"))
    for n in reversed(range(rounds)):
        reached = kept.join(hops[n], ["_key", "_us"]).select("_key", F.col("_to").alias("_us"))
        kept = stored(kept.unionByName(reached), f"kept-{n}")
    chosen = ticks.join(kept, ["_key", "_us"]).select("_row.*")
    return chosen.unionByName(rows.where(F.col("_us").isNull()).select(*anomalies.columns))


def recent_anomalies(anomalies: DataFrame, as_of: When, n: int = 50, days: int = 7) -> DataFrame:
    """The last ``n`` anomalies of every project, newest first, not older than ``days``."""
    id_col = "event_id" if "event_id" in anomalies.columns else "id"
    fresh = anomalies.where(F.col("timestamp") >= shift(instant(as_of), -days * 86400))
    return top_per_group(fresh, ["project_id"], [F.col("timestamp").desc(), F.col(id_col)], n)
