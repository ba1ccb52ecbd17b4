"""Golden rows of detectors, metrics, alerts and deliveries."""

from __future__ import annotations

import datetime as dt
import json
import random
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from sparklog import schemas
from sparklog.operators import alerts as al
from sparklog.operators import anomaly as an
from sparklog.operators import delivery as de
from sparklog.operators import metrics as met
from sparklog.operators import search as se

START = dt.datetime(2026, 1, 1)
MINUTE = dt.timedelta(minutes=1)


def counts(spark, series, step=MINUTE):
    """Counters from {service: [volume or None per bucket]}."""
    rows = [(1, s, START + i * step, v, 0, 0) for s, volumes in series.items() for i, v in enumerate(volumes) if v is not None]
    return spark.createDataFrame(rows, schemas.MINUTE_COUNTS)


@pytest.mark.parametrize("total, errors, severity", [
    (11, 2, "CRITICAL"), (10, 1, "HIGH"), (20, 1, None), (15, 1, "HIGH"), (1001, 0, "MEDIUM"), (1000, 0, None),
    (2000, 300, "CRITICAL"),
])
def test_error_rate_rule(spark, total, errors, severity):
    windows = spark.createDataFrame(
        [(1, "s", START, START + MINUTE, total, errors, 0, errors / total)], schemas.ERROR_RATE_WINDOWS
    )
    found = [r.severity for r in an.error_rate_anomalies(windows).collect()]
    assert found == ([severity] if severity else [])


GOLDEN_Z = [
    ([7] * 9, None),
    ([10] * 9 + [50], None),
    ([10] * 10 + [50], ("SPIKE", "HIGH", 13.636364, 11.499191, 3.162278)),
    ([10] * 19 + [50], ("SPIKE", "HIGH", 12.0, 8.717798, 4.358899)),
    ([10] * 26 + [50], ("SPIKE", "CRITICAL", 11.481481, 7.554103, 5.09902)),
    ([50] * 19 + [10], ("DROP", "HIGH", 48.0, 8.717798, -4.358899)),
    ([4] * 19 + [1], None),
    ([50] * 20 + [None], None),
]


@pytest.mark.parametrize("volumes, expected", GOLDEN_Z)
def test_volume_rule(spark, volumes, expected):
    as_of = START + len(volumes) * MINUTE + dt.timedelta(seconds=20)
    table = counts(spark, {"s": volumes})
    now = an.volume_anomalies(table, as_of).collect()
    back = an.volume_anomalies_backfill(table, as_of, since=START + (len(volumes) - 2) * MINUTE).collect()
    for found in (now, back):
        shown = [(r.type, r.severity, round(r.mean_volume, 6), round(r.std_dev, 6), round(r.z_score, 6)) for r in found]
        assert shown == ([expected] if expected else [])


def brute_force(series, last, span, min_points=10, min_drop_mean=5.0):
    found = set()
    for service, volumes in series.items():
        for e in range(last + 1):
            window = [v for i, v in enumerate(volumes[: e + 1]) if v is not None and i >= e - span]
            if len(window) < min_points:
                continue
            current = (volumes[e] if e < len(volumes) else None) or 0
            k, s, q = len(window), sum(window), sum(v * v for v in window)
            spread, diff = k * q - s * s, k * current - s
            beyond = diff > 0 if spread == 0 else diff * diff > 9 * spread
            if beyond and (diff > 0 or fmean(window) >= min_drop_mean):
                z = 10.0 if spread == 0 else (current - fmean(window)) / pstdev(window)
                found.add((service, e, "SPIKE" if diff > 0 else "DROP", round(z, 6)))
    return found


@pytest.mark.parametrize("slots", [96, 3])
def test_a_kept_anomaly_silences_its_key_for_a_day(spark, monkeypatch, slots):
    """Against one pass per key in time order: a hot key, returns at exactly 24 hours, ties, rows without time or key."""
    monkeypatch.setattr(an, "SLOTS", slots)
    rng, rows = random.Random(slots), []
    for key, n, days in (("hot", 900, 40), ("rare", 12, 300), ("burst", 60, 1), (None, 30, 20), ("daily", 0, 0), ("", 5, 9)):
        rows += [(key, START + dt.timedelta(seconds=rng.randrange(days * 86400))) for _ in range(n)]
    rows += [("daily", START + dt.timedelta(hours=h)) for h in (0, 0, 23.9999, 24, 47, 48, 71.5, 96, 119, 120.5)]
    rows += [("hot", None), (None, None)]
    rows = [(k, at, f"e{i:04d}") for i, (k, at) in enumerate(rows)]
    want, until = set(), {}
    for key, at, event in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[2])):
        if key not in until or at >= until[key]:
            until[key] = at + dt.timedelta(hours=24)
            want.add((key, at, event))
    table = spark.createDataFrame(rows, "deduplication_key string, timestamp timestamp, event_id string").repartition(5)
    found = [tuple(r) for r in an.dedup_anomalies(table, "24 hours").collect()]
    assert len(found) == len(set(found)) and set(found) == want | {r for r in rows if r[1] is None}
    assert ("daily", START + dt.timedelta(hours=24), next(r[2] for r in rows if r[:2] == ("daily", START + dt.timedelta(hours=24)))) in want
    assert an.dedup_anomalies(table.limit(0), "24 hours").isEmpty()


def test_counters_roll_up(spark, sf):
    """Both detectors' inputs from one counter table equal those from the logs, with records without a project."""
    from sparklog.sources import tables as t

    logs = t.logs(spark, sf).withColumn("project_id", F.when(F.col("project_id") > 1, F.col("project_id")))
    counted = met.counters(logs, "1 hour").persist()
    for left, right in (
            (an.windows_of(counted, "1 day"), an.error_rate_windows(logs, "1 day")),
            (met.counts_of(counted, "6 hours"), met.minute_counts(logs, "6 hours"))):
        assert left.columns == right.columns
        assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty() and left.count() > 0
    counted.unpersist()


@pytest.mark.parametrize("chunks", [1, 2, 7])
def test_backfill_equals_brute_force_for_every_cut(spark, chunks):
    rng = random.Random(chunks)
    series = {}
    for service, gap in (("dense", 0.0), ("gaps", 0.3), ("rare", 0.97)):
        series[service] = [
            None if rng.random() < gap else (rng.randint(200, 400) if rng.random() < 0.02 else rng.randint(8, 12))
            for _ in range(400)
        ]
    series["silent"] = [50 + i % 3 for i in range(60)] + [None] * 200 + [30] * 20
    last, span = 420, 30
    found = an.volume_anomalies_backfill(
        counts(spark, series), START + (last + 1) * MINUTE, lookback="30 minutes", chunk_lookbacks=chunks
    ).collect()
    got = {(r.service_id, int((r.timestamp - START) / MINUTE), r.type, round(r.z_score, 6)) for r in found}
    assert got == brute_force(series, last, span) and len(got) == len(found)
    assert {"SPIKE", "DROP"} == {kind for _, _, kind, _ in got}


def test_dedup_and_recent(spark):
    rows = [(1, f"s{i % 3}", "k" + str(i % 5), START + i * MINUTE, f"e{i:03d}") for i in range(200)]
    table = spark.createDataFrame(rows, "project_id long, service_id string, deduplication_key string, timestamp timestamp, event_id string")
    first = an.dedup_anomalies(table)
    assert first.columns == table.columns
    assert sorted(r.event_id for r in first.collect()) == ["e000", "e001", "e002", "e003", "e004"]
    recent = an.recent_anomalies(table.repartition(7), START + 200 * MINUTE, n=50).orderBy("rank").collect()
    assert [r.event_id for r in recent] == [f"e{i:03d}" for i in range(199, 149, -1)]


def test_metric_definitions(spark):
    defs = spark.createDataFrame([
        (1, 1, "ok", "a.*"), (2, 1, "bad", "(["), (3, 1, " ", "x"), (4, 1, "n", None), (5, 1, "quote", r"\Qa.b"),
        (6, 1, "comment", "(?x) a .* # rest"), (7, 2, "other project", "a.*"),
    ], "id long, project_id long, name string, regex_pattern string")
    ok, rejected = met.validate_metric_defs(defs)
    assert sorted(r.id for r in ok.collect()) == [1, 5, 6, 7]
    assert {r.id: r.reason[:7] for r in rejected.collect()} == {2: "Invalid", 3: "Name an", 4: "Name an"}
    logs = spark.createDataFrame([
        ("l1", 1, "abc"), ("l2", 1, "abc\n"), ("l3", 1, "a.b"), ("l4", 2, "abc"), ("l5", 1, None), ("l6", None, "abc"),
    ], "log_id string, project_id long, message string")
    plain = {("l1", 1), ("l1", 6), ("l3", 1), ("l3", 5), ("l3", 6), ("l4", 7)}
    assert {(r.log_id, r.metric_id) for r in met.match_metrics(logs, defs).collect()} == plain
    homeless = spark.createDataFrame([(8, None, "no project", ".*")], defs.schema)
    for cap, index_from in ((0, 100), (64, 100), (0, 0), (64, 0)):
        got = met.match_metrics(logs, defs.unionByName(homeless), max_rows=cap, index_from=index_from).collect()
        assert {(r.log_id, r.metric_id) for r in got} == plain and len(got) == len(plain)


def test_required_texts_lose_no_match(spark):
    """Random patterns and messages: the look-up by required texts finds what the patterns match one by one."""
    import random
    import re

    rng = random.Random(8)
    parts = ["order", "ab?", "c+", "x{2}", "x{0,2}y", "[a-d]", r"[^\]]", r"\d{1,3}", r"\.", r"\x41", r"\w+", "(ab)?", "(ab|cd)", "((x)y)*", "(?:user)", ".*",
             ".", "=", " k: ", "é", "user ", "a*?b", "d++", r"\bend\b", "^", "$", "(?i:B)"]
    patterns = sorted({"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(150)} | {"(?s).*a.b.*", "(?i)ORDER", "order|x", "a{2}"})
    words = ["order", "ab", "a", "cc", "xx", "xxy", "y", "b", "12", ".", "A", "w_1", "cd", "xy", "user", "=", " k: ", "é", "user ", "b", "dd", "end", "B"]
    messages = sorted({"".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(1500)} | {"", "a\nb", "ORDER", "x", "aa"})
    defs = spark.createDataFrame([(i, i % 2, "m", p) for i, p in enumerate(patterns)], "id long, project_id long, name string, regex_pattern string")
    logs = spark.createDataFrame([(m, p) for m in messages for p in (0, 1)], "message string, project_id long")
    want = {(m, i) for i, p in enumerate(patterns) for m in messages if re.fullmatch(p, m, re.ASCII)}
    for index_from in (0, 10_000):
        got = [(r.message, r.metric_id) for r in met.match_metrics(logs, defs, index_from=index_from).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 300


def test_rules_are_tried_once_and_found_by_short_texts(spark):
    """Equal patterns are one rule, repeated and absent ids each count, and a text in reach of alternatives or of few characters is a key."""
    defs = spark.createDataFrame([
        (1, 1, "m", ".{1,9}"), (2, 1, "m", ".{1,9}"), (2, 1, "m", ".{1,9}"), (None, 1, "m", ".{1,9}"), (4, 1, "m", "order.*"), (4, 1, "m", ".*paid.*"),
        (5, 2, "m", ".{1,9}"),
    ], "id long, project_id long, name string, regex_pattern string")
    logs = spark.createDataFrame([("a", 1, "orders"), ("b", 1, "it is paid"), ("c", 2, "orders"), ("d", 3, "x")], "log_id string, project_id long, message string")
    want = sorted([("a", 1), ("a", 2), ("a", 2), ("a", -1), ("a", 4), ("b", 4), ("c", 5)])
    for cap, index_from in ((0, 100), (64, 100), (0, 0), (64, 0)):
        found = met.match_metrics(logs, defs, max_rows=cap, index_from=index_from)
        assert found.columns == ["log_id", "project_id", "message", "metric_id"]
        assert sorted((r.log_id, -1 if r.metric_id is None else r.metric_id) for r in found.collect()) == want

    patterns = [".*(click|view).* 12.*", "[a-z]+ .*k.*: ?7\\}?", "user[^ ]* 3.*", ".{1,9}", "order|x", "a(b|(c|d))?e"]
    texts = spark.createDataFrame([(p,) for p in patterns], "p string").select(
        met.required_texts(F.col("p")).alias("t"), met._keys(met.required_texts(F.col("p"))).alias("k")).collect()
    assert [r.t for r in texts] == [[" 12"], [" ", "k", ":", "7"], ["user", " 3"], [], [], ["a", "e"]]
    assert [r.k for r in texts] == [[" 12"], [], ["user", " 3"], [], [], []]


def test_metric_series_has_no_gaps(spark):
    defs = spark.createDataFrame([(5, 1)], "id long, project_id long")
    table = spark.createDataFrame([(1, 5, START, 3), (1, 5, START - 90 * MINUTE, 9)], schemas.METRIC_COUNTS)
    rows = met.metric_series(table, defs, START + dt.timedelta(seconds=30)).collect()
    assert len(rows) == 60 and rows[-1].bucket == START and [r["count"] for r in rows] == [0] * 59 + [3]


def test_counts_sum_to_the_rows(spark, sf):
    from sparklog.sources import tables as t

    logs = t.logs(spark, sf)
    assert met.minute_counts(logs).agg(F.sum("total")).first()[0] == logs.count()


# --- search ---------------------------------------------------------------------------------------------

def docs(spark, *rows):
    base = dict.fromkeys(se.DOCUMENT_COLUMNS)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], schemas.table(
        id="string", service_id="string", level="string", project_id="long", message="string", timestamp="timestamp",
        trace_id="string", span_id="string", parent_span_id="string"))


ANNOTATED = [
    ("INFO", "userid 42 request for login", ("Login Request", "42", None, False, False)),
    ("INFO", "order A7 created", ("Order Created", None, None, False, False)),
    ("INFO", "USERID 9 Request for login and order B1 created", ("Order Created", "9", None, False, False)),
    ("ERROR", "Database connection refused during payment processing.", (None, None, "Database", False, False)),
    ("WARN", "Timeout at the firewall", (None, None, "Routine", True, False)),
    ("WARN", "Timeout at the firewall: JdbcConnectionException", (None, None, "Database", False, True)),
    ("WARN", "High latency detected on Payment API (850ms)", (None, None, "Unhandled", False, False)),
    ("FATAL", "OutOfMemoryError", (None, None, None, False, False)),
    (None, "order X created", ("Order Created", None, None, False, False)),
    ("ERROR", "NullPointerException\n\tat a.B", (None, None, "Attempted", False, True)),
]


def test_annotation(spark):
    rows = docs(spark, *[{"id": str(i), "level": lv, "message": m} for i, (lv, m, _) in enumerate(ANNOTATED)]).coalesce(1)
    for row, (_, message, want) in zip(se.annotate_logs(rows).collect(), ANNOTATED, strict=True):
        cause = row.root_cause.split()[0] if row.root_cause else None
        assert (row.action, row.user, cause, row.is_ignorable, row.has_stack_trace) == want, message
        if want[4]:
            assert row.extracted_message == message.split("\n")[0]


def test_search_modes(spark):
    rows = docs(spark, {"id": "1", "project_id": 1, "message": "Fire-wall down"}, {"id": "2", "project_id": 1, "message": "firewall"},
                {"id": "3", "project_id": 2, "message": "firewall"})
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(se.search_logs(rows, 1, "FIREWALL")) == ["2"]
    assert ids(se.search_logs(rows, 1, "e-w")) == ["1"] and ids(se.search_logs(rows, 1, "e-w", mode="token")) == []
    assert ids(se.search_logs(rows, 1, "wall", mode="token")) == ["1", "2"]
    with pytest.raises(ValueError):
        se.search_logs(rows, 1, "two words", mode="token")


def test_feed_order_and_filter(spark):
    rows = docs(spark, {"id": "a", "service_id": "svc", "level": "INFO", "message": "x", "timestamp": START},
                {"id": "b", "message": "svc in text"}, {"id": "c", "service_id": "", "timestamp": START + MINUTE})
    volume = spark.createDataFrame([], schemas.VOLUME_ANOMALY)
    feed = se.console_feed(rows, volume)
    assert [r.id for r in feed.collect()] == ["c", "a", "b"]
    assert sorted(r.id for r in se.console_filter(feed, "SVC").collect()) == ["a", "b"]
    both = rows.withColumn("project_id", F.expr("case when id = 'a' then 9 else project_id end"))
    assert [r.id for r in se.console_feed(both, volume, project_id=9).collect()] == ["a"]
    assert [r.id for r in se.console_feed(rows, volume, limit=2).collect()] == ["c", "a"]
    assert sorted(r.service_id for r in se.feed_services(feed).collect()) == ["ALL", "svc"]


# --- alerts and deliveries ------------------------------------------------------------------------------

URLS = {
    "https://hooks.example.com/a": None, "HTTPS://Hooks.example.com": None, "http://172.32.0.1/": None,
    "http://[2001:db8::1]/": None, "ftp://x.example/": "Only", "": "URL is", " ": "URL is", "nope": "Only",
    "http://bad host/": "Invalid", "http:///x": "URL must", "http://LOCALHOST/": "Host", "http://0.0.0.0/": "Host",
    "http://127.0.0.1/": "Host", "http://127.1.2.3/": "Resolved", "http://10.1.2.3/": "Resolved", "http://010.1.2.3/": "Resolved",
    "http://172.16.0.1/": "Resolved", "http://172.31.0.1/": "Resolved", "http://192.168.1.5/": "Resolved",
    "http://169.254.169.254/": "Resolved", "http://[::1]/": "Resolved", "http://[0:0:0:0:0:0:0:1]/": "Resolved",
    "http://[fe80::1]/": "Resolved", "http://[fd00::1]/": "Resolved", "http://[::ffff:10.0.0.1]/": "Resolved",
    "http://2130706433/": "Resolved", "http://[::ffff:7f00:1]/": "Resolved", "http://127.1/": "URL must",
    "http://10.1.515/": "URL must", "http://[fe90::1]/": "Resolved", "http://[febf::1]/": "Resolved",
    "http://[fec0::1]/": None, "http://[::ffff:808:808]/": None, "http://134744072/": None, "http://4294967296/": None,
}


def test_url_policy(spark):
    rows = spark.createDataFrame([(u,) for u in [*URLS, None]], "url string")
    for row in al.url_policy(rows, "url").collect():
        want = URLS.get(row.url, "URL is")
        assert row.is_valid == (want is None), row
        assert want is None or row.error.startswith(want), row


def test_normalise_and_route(spark):
    volume = {"schemaVersion": 1, "eventId": "v", "projectId": 1, "serviceId": "s", "severity": "high", "type": "SPIKE",
              "zScore": 4.25, "timestamp": 1726480800.7, "currentVolume": 9, "meanVolume": 2.5, "stdDev": 1.5}
    rate = {"id": "r", "projectId": 1, "serviceId": "s", "severity": "CRITICAL", "description": "d",
            "timestamp": "2024-09-16T10:00:00Z", "metrics": {"errorRate": 0.5, "totalCount": 4, "errorCount": 2}}
    quiet = {"eventId": "q", "projectId": 1, "serviceId": "s"}
    rows = spark.createDataFrame([(json.dumps(x),) for x in (volume, rate, quiet)] + [("{no",)], "value string")
    events = {r.event_id: r for r in al.normalize_anomalies(rows, "value", START).collect()}
    assert set(events) == {"v", "r", "q"}
    assert events["v"].description == "Volume SPIKE detected for service s (Z-Score: 4.25)"
    assert events["v"].timestamp == events["r"].timestamp == dt.datetime(2024, 9, 16, 10, 0)
    assert events["r"].metrics.error_rate == 0.5 and events["r"].description == "d"
    assert events["q"].metrics is None and events["q"].timestamp is None and events["q"].schema_version == 0
    strict = {r.event_id for r in al.normalize_anomalies(rows, "value", START, strict=True).collect()}
    assert strict == {"v", None, "q"}
    routed = al.route_alerts(al.normalize_anomalies(rows, "value", START))
    assert {r.event_id for r in routed.collect()} == {"v", "r"}
    body = al.render_alerts(al.normalize_anomalies(rows, "value", START).where("event_id = 'q'")).first()
    assert "- Severity: null" in body.body and "- Detection Time: unknown" in body.body


def test_fan_out_is_idempotent(spark):
    event = dict.fromkeys(schemas.ANOMALY_EVENT.names)
    events = spark.createDataFrame([
        tuple({**event, "event_id": e, "project_id": p, "schema_version": 1, "timestamp": START}.values())
        for e, p in (("e", 1), (None, 1), ("f", None))
    ], schemas.ANOMALY_EVENT)
    subs = spark.createDataFrame(
        [(1, 1, "u", "s", True, START, START), (2, 1, "u", "s", True, START, START), (3, 1, "u", "s", False, START, START)],
        schemas.SUBSCRIPTIONS)
    none = spark.createDataFrame([], schemas.DELIVERIES)
    first = de.enqueue_deliveries(events.unionByName(events), subs, none, START)
    assert first.schema.names == schemas.DELIVERIES.names
    rows = first.collect()
    assert sorted(r.subscription_id for r in rows) == [1, 2] and {r.status for r in rows} == {"PENDING"}
    assert json.loads(rows[0].payload)["timestamp"] == "2026-01-01T00:00:00Z"
    assert de.enqueue_deliveries(events, subs, first, START).count() == 0


LADDER = [
    (0, 204, None, "DELIVERED", 1, None, False), (0, 404, None, "FAILED", 1, None, False),
    (0, 500, None, "RETRY_PENDING", 1, 30, False), (1, 429, None, "RETRY_PENDING", 2, 120, False),
    (2, None, "HttpTimeoutException", "RETRY_PENDING", 3, 600, False), (3, 408, None, "RETRY_PENDING", 4, 1800, False),
    (4, 503, None, "FAILED", 5, None, True), (4, None, "IOException", "FAILED", 5, None, True),
    (4, 400, None, "FAILED", 5, None, False), (4, 200, None, "DELIVERED", 5, None, False),
]


def test_retry_ladder_and_dead_letters(spark):
    due, done = START, START + MINUTE
    deliveries = spark.createDataFrame([
        (str(i), 1, f"e{i}", "{}", "PENDING", before, None, None, due, None, None, START, START)
        for i, (before, *_) in enumerate(LADDER)
    ] + [("idle", 1, "x", "{}", "PENDING", 0, None, None, due, None, None, START, START)], schemas.DELIVERIES)
    outcomes = spark.createDataFrame(
        [(str(i), http, error, 12, "b", done) for i, (_, http, error, *_) in enumerate(LADDER)], schemas.OUTCOMES)
    applied = de.apply_attempts(deliveries, outcomes)
    rows = {r.id: r for r in applied.collect()}
    for i, (_, http, error, status, attempts, delay, dead) in enumerate(LADDER):
        row = rows[str(i)]
        assert (row.status, row.attempts, row.http_status, row.dead) == (status, attempts, http, dead), row
        assert row.next_attempt_at == (done + dt.timedelta(seconds=delay) if delay else due)
        assert (row.delivered_at is None) == (status == "RETRY_PENDING")
        assert (row.last_error is None) == (status == "DELIVERED")
    assert rows["idle"].status == "PENDING" and rows["idle"].attempts == 0
    letters = de.dead_letters(applied).collect()
    assert {r.id: (r.last_http_status, r.attempts) for r in letters} == {"6": (503, 5), "7": (None, 5)}
    assert len(rows) == deliveries.count()


def test_stale_and_repeated_outcomes_change_nothing(spark):
    rows = [(i, 1, f"e{i}", "{}", status, 1, 200, 1, START, START, None, START, START)
            for i, status in (("done", "DELIVERED"), ("failed", "FAILED"), ("due", "PENDING"))]
    deliveries = spark.createDataFrame(rows, schemas.DELIVERIES)
    outcomes = spark.createDataFrame(
        [(i, http, None, 1, "b", START + k * MINUTE) for i, http, k in
         (("done", 500, 1), ("failed", 200, 1), ("due", 500, 2), ("due", 204, 1), ("none", 200, 1), ("due", 204, 1))],
        schemas.OUTCOMES)
    got = {r.id: (r.status, r.attempts) for r in de.apply_attempts(deliveries, outcomes).collect()}
    assert got == {"done": ("DELIVERED", 1), "failed": ("FAILED", 1), "due": ("DELIVERED", 2)}
    left = {(r.delivery_id, r.ignored, r.reason) for r in de.ignored_outcomes(deliveries, outcomes).collect()}
    assert left == {("done", 1, "not waiting"), ("failed", 1, "not waiting"), ("due", 2, "repeated"),
                    ("none", 1, "unknown delivery")}


def test_replay(spark):
    rows = [(str(i), s, f"e{i}", "{}", status, 5, 503, 1, START, START, "x", START, START)
            for i, (s, status) in enumerate([(1, "FAILED"), (1, "DELIVERED"), (2, "FAILED")])]
    deliveries = spark.createDataFrame(rows, schemas.DELIVERIES)
    subs = spark.createDataFrame([(1, 1, "u", "s", True, START, START), (2, 2, "u", "s", True, START, START)], schemas.SUBSCRIPTIONS)
    asked = spark.createDataFrame([("0", 1), ("0", 1), ("1", 1), ("2", 1), ("9", 1)], "delivery_id string, project_id long")
    updated, refused = de.replay_deliveries(deliveries, subs, asked, START + MINUTE)
    only = updated.collect()
    assert [(r.id, r.status, r.attempts, r.last_error) for r in only] == [("0", "PENDING", 0, None)]
    assert {r.delivery_id: r.reason.split()[0] for r in refused.collect()} == {"1": "Cannot", "2": "Delivery", "9": "Delivery"}
