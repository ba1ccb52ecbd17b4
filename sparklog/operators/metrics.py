"""Counters, dashboards and regex-defined custom metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog import constants as C
from sparklog.functions.clock import bucket_start, bucket_text, instant, shift, width_seconds
from sparklog.functions.levels import is_error, is_warning
from sparklog.functions.text import not_blank
from sparklog.operators.ingest import When
from sparklog.operators.joins import MAX_BYTES, MAX_ROWS, join_dim

#: Characters of the runs by which many definitions are looked up, and the number a project from which they are.
GRAM = 4
INDEX_FROM = 200
#: Nested groups that the search for required texts looks through.
GROUP_DEPTH = 6


# --- counters -------------------------------------------------------------------------------------------

def minute_counts(logs: DataFrame, width: str = "1 minute") -> DataFrame:
    """Total, error and warn counts per (project or 0, service, bucket).

    Partial aggregation runs before the shuffle, so a hot service costs one row per task and bucket.
    Works on streams as well: the window column carries the watermark.
    """
    return (
        logs.groupBy(
            F.coalesce(F.col("project_id"), F.lit(0)).cast("bigint").alias("project_id"),
            "service_id",
            F.window("timestamp", width).alias("_window"),
        )
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(is_error(F.col("level"))).alias("error"),
            F.count_if(is_warning(F.col("level"))).alias("warn"),
        )
        .select("project_id", "service_id", F.col("_window.start").alias("bucket"), "total", "error", "warn")
    )


def counters(logs: DataFrame, width: str = "1 minute") -> DataFrame:
    """Total, error and warn counts per (project, service, bucket), records without a project for themselves.

    The one table from which all coarser counts follow: :func:`counts_of` and ``anomaly.windows_of`` roll it up, so the logs
    are read and parsed once for both detectors, the dashboards and the charts.
    """
    return logs.groupBy("project_id", "service_id", F.window("timestamp", width)["start"].alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_error(F.col("level"))).alias("error"),
        F.count_if(is_warning(F.col("level"))).alias("warn"),
    )


def counts_of(counted: DataFrame, width: str = "1 minute") -> DataFrame:
    """:func:`minute_counts` from counters of a width that divides ``width``."""
    return counted.groupBy(
        F.coalesce(F.col("project_id"), F.lit(0)).cast("bigint").alias("project_id"), "service_id",
        F.window("bucket", width)["start"].alias("bucket"),
    ).agg(*[F.sum(c).alias(c) for c in ("total", "error", "warn")])


def _recent(counts: DataFrame, as_of: When, hours: int) -> DataFrame:
    return counts.where(F.col("bucket") >= shift(instant(as_of), -hours * 3600))


def dashboard_metrics(counts: DataFrame, as_of: When, hours: int = 25) -> DataFrame:
    """Sums and error rate over the recent buckets, for every (project, service) in one job."""
    sums = _recent(counts, as_of, hours).groupBy("project_id", "service_id").agg(
        F.sum("total").alias("total_logs"),
        F.sum("error").alias("error_count"),
        F.sum("warn").alias("warning_count"),
    )
    rate = F.coalesce(F.try_divide(F.col("error_count").cast("double"), F.col("total_logs")), F.lit(0.0))
    return sums.withColumn("error_rate", rate)


def error_timeline(counts: DataFrame, as_of: When, hours: int = 25) -> DataFrame:
    """Error count per recent bucket, as rows with the bucket as text."""
    return _recent(counts, as_of, hours).select(
        "project_id", "service_id", bucket_text(F.col("bucket")).alias("bucket"),
        F.col("error").alias("error_count"),
    )


def error_timeline_maps(counts: DataFrame, as_of: When, hours: int = 25) -> DataFrame:
    """The timeline as one sorted map per (project, service); its size is bounded by ``hours``."""
    points = F.array_sort(F.collect_list(F.struct("bucket", "error_count")))
    return error_timeline(counts, as_of, hours).groupBy("project_id", "service_id").agg(
        F.map_from_entries(points).alias("timeline")
    )


def volume_at(counts: DataFrame, keys: DataFrame, minute: When) -> DataFrame:
    """Volume of one bucket for every key; 0 where the bucket is absent."""
    volumes = counts.where(F.col("bucket") == instant(minute)).select("project_id", "service_id", "total")
    joined = keys.select("project_id", "service_id").join(volumes, ["project_id", "service_id"], "left")
    return joined.select("project_id", "service_id", F.coalesce("total", F.lit(0)).alias("volume"))


# --- custom metrics -------------------------------------------------------------------------------------

def _compiles(pattern: Column) -> Column:
    """True if the text is a Java regular expression; checked where the row is, not on the driver."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def validate_metric_defs(defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected): name and pattern present and the pattern compiles; rejected rows say why."""
    present = not_blank(F.col("name")) & not_blank(F.col("regex_pattern"))
    checked = defs.withColumn(
        "reason",
        F.when(~present, C.METRIC_FIELDS_REQUIRED).when(~_compiles(F.col("regex_pattern")), C.METRIC_BAD_REGEX),
    )
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def _whole(pattern: str) -> str:
    """Anchored form: the pattern must match the whole text (``$`` would let a last newline pass)."""
    return rf"\A(?:{pattern})\z"


def required_texts(pattern: Column) -> Column:
    """The texts that every match of a regular expression contains; an empty array where none is known.

    Everything that is not plain text, or that a quantifier makes optional, becomes a gap, groups with their alternatives too; the pieces
    between gaps are left. Patterns with alternatives outside groups, quoting, or groups that set flags have no known text; the one
    exception is a leading ``(?s)``.
    """
    gap = "\0"
    plain = F.regexp_replace(pattern, r"^\(\?s\)", "")
    for syntax in (
        r"\\[A-Za-z0-9](?:\{[^}]*\}|<[^>]*>|[0-9A-Za-z]*)",  # classes, code points, references: with what could belong to them
        r"\\.",
        r"\[\^?\]?[^\]]*\]",
    ):
        plain = F.regexp_replace(plain, f"(?s){syntax}", gap)
    for _ in range(GROUP_DEPTH):
        plain = F.regexp_replace(plain, r"\([^()]*\)", gap)
    unknown = pattern.contains("\\Q") | pattern.substr(F.lit(2), F.length(pattern)).contains("(?") | (
        pattern.startswith("(?") & ~pattern.startswith("(?s)")) | pattern.contains("[[") | pattern.contains("&&") | plain.rlike("[()|]")
    plain = F.regexp_replace(plain, r"(?s).(?:[?*]|\{[^}]*\})[?+]?", gap)
    pieces = F.split(F.regexp_replace(plain, r"[+.^$?*{}\]\n]", gap), gap)
    return F.when(unknown, F.array().cast("array<string>")).otherwise(F.filter(pieces, lambda p: p != ""))


def required_literal(texts: Column) -> Column:
    """The longest of :func:`required_texts`; empty where none is known."""
    return F.reduce(texts, F.lit(""), lambda best, one: F.when(F.length(one) > F.length(best), one).otherwise(best))


def _grams(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of so many characters of a text."""
    # A look-ahead takes no character, so the runs overlap.
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]))


def _keys(texts: Column) -> Column:
    """The runs by which a rule may be looked up: GRAM characters of its texts, shorter texts whole, single characters never."""
    def of(text: Column) -> Column:
        return F.when(F.length(text) >= GRAM, _grams(text, [GRAM])).when(F.length(text) > 1, F.array(text)).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(texts, of)))


def _with_gram(rules: DataFrame) -> DataFrame:
    """Rules with ``_gram``, the run of their texts that the fewest rules of the project have; null without one."""
    every = rules.select("project_id", "regex_pattern", F.explode(_keys(F.col("_texts"))).alias("_gram"))
    uses = every.groupBy("project_id", "_gram").agg(F.count(F.lit(1)).alias("_uses"))
    rarest = every.join(uses, ["project_id", "_gram"]).groupBy("project_id", "regex_pattern").agg(
        F.min_by("_gram", F.struct("_uses", -F.length("_gram"), "_gram")).alias("_gram"))
    return rules.join(rarest, ["project_id", "regex_pattern"], "left").drop("_texts")


def match_metrics(logs: DataFrame, defs: DataFrame, max_rows: int = MAX_ROWS, index_from: int = INDEX_FROM) -> DataFrame:
    """Log rows with the id of every valid metric of their project whose regex matches the whole message.

    Definitions of a project with the same pattern are one rule, which is tried once. A join on the project whose residual condition looks
    for the text that a pattern requires before it tries the pattern, so pairs that do not match are never produced and few patterns are
    compiled. From ``index_from`` rules a project on, the rules are looked up by a run of up to GRAM characters of their required texts
    instead: the work of a message then depends on its length and not on their number; only patterns without such a text are tried on
    all messages of their project, each compiled anew for each message.
    Definitions and rows without a project match nothing. Up to ``max_rows`` definitions of a measured size are broadcast.
    """
    ok, _ = validate_metric_defs(defs.where(F.col("project_id").isNotNull()))
    # In structs, so that a definition without an id counts too.
    same = ok.groupBy("project_id", "regex_pattern").agg(F.collect_list(F.struct(F.col("id").alias("metric_id"))).alias("_metrics"))
    rules = same.withColumn("_texts", required_texts(F.col("regex_pattern"))).select(
        "project_id", "regex_pattern", "_metrics", "_texts", required_literal(F.col("_texts")).alias("_literal"),
        F.format_string(_whole("%s"), "regex_pattern").alias("_whole"),
        # A pattern such as an unclosed quote compiles alone but not inside the anchored form.
        _compiles(F.format_string(_whole("%s"), "regex_pattern")).alias("_anchors"),
    )
    bytes_of = 2 * F.octet_length("_whole") + F.octet_length("_literal") + 64 * F.size("_metrics")
    n, distinct, size, projects = rules.agg(
        F.coalesce(F.sum(F.size("_metrics")), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(bytes_of), F.lit(0)),
        F.approx_count_distinct("project_id")).first()
    fits = n <= max_rows and size <= MAX_BYTES
    candidates = logs.where(F.col("project_id").isNotNull() & F.col("message").isNotNull())
    tried = F.expr("contains(message, _literal) and (not _anchors or message rlike _whole)")
    if distinct < index_from * max(projects, 1):
        pairs = join_dim(candidates, rules.drop("_texts"), ["project_id"], condition=tried, fits=fits)
    else:
        ruled = _with_gram(rules)
        pairs = join_dim(candidates, ruled.where(F.col("_gram").isNull()).drop("_gram"), ["project_id"], condition=tried, fits=fits)
        sizes = sorted(ruled.where(F.col("_gram").isNotNull()).agg(F.collect_set(F.length("_gram"))).first()[0])
        if sizes:
            words = candidates.withColumn("_gram", F.explode(_grams(F.col("message"), sizes)))
            found = join_dim(words, ruled.where(F.col("_gram").isNotNull()), ["project_id", "_gram"], condition=tried, fits=fits)
            pairs = found.drop("_gram").unionByName(pairs)
    whole = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), F.col("regex_pattern"), F.col("message"))
    matched = pairs.where(F.col("_anchors") | (whole == "true")).drop("regex_pattern", "_whole", "_anchors", "_literal")
    return matched.select(*[c for c in matched.columns if c != "_metrics"], F.inline("_metrics"))


def metric_counts(logs: DataFrame, defs: DataFrame, width: str = "1 minute") -> DataFrame:
    """Matches per (project, metric, bucket)."""
    return (
        match_metrics(logs.select("project_id", "message", "timestamp"), defs)
        .groupBy("project_id", "metric_id", F.window("timestamp", width).alias("_window"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("project_id", "metric_id", F.col("_window.start").alias("bucket"), "count")
    )


def chart_points(points: DataFrame) -> DataFrame:
    """Points that have both a time and a count."""
    return points.where(F.col("bucket").isNotNull() & F.col("count").isNotNull())


def metric_series(
    counts: DataFrame, defs: DataFrame, as_of: When, points: int = 60, width: str = "1 minute"
) -> DataFrame:
    """The last ``points`` buckets of every metric up to the current one, gaps as 0."""
    last = bucket_start(instant(as_of), width)
    step = width_seconds(width)
    buckets = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)), lambda i: shift(last, -i.cast("bigint") * step)
    )
    spine = defs.select("project_id", F.col("id").alias("metric_id"), F.explode(buckets).alias("bucket"))
    recent = chart_points(counts).where(
        (F.col("bucket") > shift(last, -points * step)) & (F.col("bucket") <= last)
    )
    return (
        spine.join(recent, ["project_id", "metric_id", "bucket"], "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .orderBy("project_id", "metric_id", "bucket")
    )
