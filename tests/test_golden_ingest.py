"""Golden rows of the ingest operators and scalar functions."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sparklog import schemas
from sparklog.functions.clock import bucket_start, instant, parse_bucket, parse_event_time
from sparklog.functions.keys import dedup_key, hash_api_key, hmac_pads, hmac_sha256
from sparklog.functions.levels import level_severity
from sparklog.functions.text import preview, redact
from sparklog.operators import ingest as ing
from sparklog.sources import readers, sinks

T = dt.datetime(2026, 10, 1, 12, 0)
TRACE, SPAN = "4bf92f3577b34da6a3ce929d0e0e4736", "00f067aa0ba902b7"


def raw(spark, *rows):
    schema = f"record_id string, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schemas.LOG_RAW.fields)}"
    base = dict.fromkeys(["record_id", *schemas.LOG_RAW.names])
    return spark.createDataFrame([tuple({**base, **row}.values()) for row in rows], schema)


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").coalesce(1)


@pytest.mark.parametrize("header, expected", [
    (f"00-{TRACE}-{SPAN}-01", (TRACE, SPAN)),
    (f"  00-{TRACE}-{SPAN}-01 \t", (TRACE, SPAN)),
    (f"00-{TRACE}-{SPAN}-01-", (TRACE, SPAN)),
    (f"00-{'0' * 32}-{SPAN}-01", ("0" * 32, SPAN)),
    (f"00-{TRACE}-{'0' * 16}-01", ("own", None)),
    (f"01-{TRACE}-{SPAN}-01", ("own", None)),
    (f"00-{TRACE.upper()}-{SPAN}-01", ("own", None)),
    (f"00-{TRACE}-{SPAN}", ("own", None)),
    (f"00-{TRACE}-{SPAN}-01-x", ("own", None)),
    ("   ", ("own", None)),
    (None, ("own", None)),
])
def test_traceparent(spark, header, expected):
    row = ing.parse_traceparent(raw(spark, {"traceparent": header, "trace_id": "own"})).first()
    assert (row.trace_id, row.parent_span_id) == expected


PARSE = [
    ("JSON", '{"message":"m","level":"warn","timestamp":"2026-01-15T10:30:00Z"}', "m", "WARN", dt.datetime(2026, 1, 15, 10, 30)),
    ("JSON", '{"level":"loud"}', None, "INFO", T),
    ("JSON", "database unavailable", None, "ERROR", dt.datetime(2026, 9, 16, 10, 0)),
    ("JSON", '{"timestamp":"yesterday","trace_id":"t1"}', None, "INFO", T),
    ("AUTO_DETECT", '  {"message":"m"}', "m", "INFO", T),
    ("AUTO_DETECT", "plain", None, None, T),
    ("AUTO_DETECT", "{broken", None, "ERROR", dt.datetime(2026, 9, 16, 10, 0)),
    ("SYSLOG", '{"message":"m"}', None, None, T),
    ("PLAIN_TEXT", "anything", None, None, T),
    ("JSON", "12 ab", None, "INFO", T),
    ("JSON", '"text"', None, "INFO", T),
    ("JSON", "[1, 2]", None, "INFO", T),
    ("JSON", '{"message":{"a":1},"level":null}', "", "INFO", T),
    ("JSON", '{"message":null,"level":"FATAL"}', None, "FATAL", T),
    ("JSON", '{"message":"{not nested}","level":"Debug"}', "{not nested}", "DEBUG", T),
    ("JSON", '{"message":"a","message":"b"}', "b", "INFO", T),
]


def test_parse(spark):
    rows = raw(spark, *[
        {"record_id": str(i), "format": f, "message": m, "service_id": "s", "level": "ERROR",
         "timestamp": "2026-09-16T10:00:00Z", "trace_id": "own", "project_id": 1}
        for i, (f, m, *_) in enumerate(PARSE)
    ]).coalesce(1)
    parsed = ing.parse_logs(rows, T).collect()
    assert len(parsed) == len(PARSE) and len({r.id for r in parsed}) == len(PARSE)
    for (fmt, message, text, level, time), row in zip(PARSE, parsed, strict=True):
        assert (row.message, row.level, row.timestamp) == (message if text is None else text, level, time), (fmt, message)
        assert row.raw_log == message and row.trace_id == ("t1" if "t1" in message else "own")
    strict = ing.parse_logs(rows, T, strict=True).collect()
    assert [r.trace_id for r in strict] == [
        None if r.level is None else ("t1" if "t1" in r.raw_log else "own") for r in strict
    ]
    assert ing.parse_logs(rows, T).schema.names == schemas.LOG_ENTRY.names


def test_redaction_golden(spark):
    given = [
        "a.b@c.io from 10.0.0.1 card 4111 1111 1111 1111 id 20260916100000",
        "4111-1111-1111-1111!",
        "v 999.1.1.1 n 123456789012 12345678901234567",
        None,
        "nothing to hide",
        "x@y",
    ]
    assert column(texts(spark, *given), redact(F.col("x"))) == [
        "[REDACTED_EMAIL] from [REDACTED_IP] card [REDACTED_CC] id [REDACTED_CC]",
        "[REDACTED_CC]!",
        "v [REDACTED_IP] n 123456789012 12345678901234567",
        None,
        "nothing to hide",
        "x@y",
    ]


def test_redaction_is_idempotent(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(redact(F.col("text")).alias("once"))
    assert docs.where(redact(F.col("once")) != F.col("once")).count() == 0


def test_event_times(spark):
    given = ["2026-09-16T10:00:00Z", "2026-09-16t10:00:00.5z", "1726480800.9", "1726480800", "1.7264808E9", "-1.5",
             "2026-09-16", "", "NaN", None, "2026-09-16T12:00:00+02:00", "9e40"]
    out = column(texts(spark, *given), parse_event_time(F.col("x"), instant(T)))
    ten = dt.datetime(2026, 9, 16, 10, 0)
    epoch = dt.datetime(2024, 9, 16, 10, 0)
    assert out == [ten, ten.replace(microsecond=500000), epoch, epoch, epoch, dt.datetime(1969, 12, 31, 23, 59, 59),
                   T, T, T, T, ten, T]


def test_buckets(spark):
    df = texts(spark, "2026-09-16T10:00", "nope")
    assert column(df, parse_bucket(F.col("x"))) == [dt.datetime(2026, 9, 16, 10, 0), None]
    one = spark.range(1)
    assert column(one, bucket_start(instant("1969-12-31T23:59:30"), "1 minute")) == [dt.datetime(1969, 12, 31, 23, 59)]
    assert column(one, dedup_key(F.lit(1), F.lit("s"), "volume", instant("2026-01-15T10:30:00"))) == [
        "1:s:volume:2026-01-15T10:30:00Z"
    ]


def test_severity_and_hash(spark):
    levels = texts(spark, "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "info", None)
    assert column(levels, level_severity(F.col("x"))) == [1, 2, 3, 4, 5, 6, None, None]
    assert column(texts(spark, "key-1"), hash_api_key(F.col("x"))) == [
        __import__("hashlib").sha256(b"key-1").hexdigest()
    ]


def test_hmac_equals_the_standard_library(spark):
    import hashlib
    import hmac

    pairs = [("k", "p"), ("", ""), ("é" * 40, "päyload"), ("x" * 64, "a"), ("y" * 65, "b"), ("z" * 200, "c" * 300)]
    df = spark.createDataFrame(pairs, "k string, p string").coalesce(1)
    inner, outer = hmac_pads(F.col("k"))
    got = column(df, hmac_sha256(inner, outer, F.col("p")))
    assert got == [hmac.new(k.encode(), p.encode(), hashlib.sha256).hexdigest() for k, p in pairs]


def test_preview(spark):
    given = ["a\n\n b  c ==== d", "x" * 91, "y" * 90, None, " === ", "﻿　z"]
    assert column(texts(spark, *given), preview(F.col("x"))) == ["a b c  d", "x" * 90 + "...", "y" * 90, "", "", "z"]


def test_validation_splits_the_input(spark):
    rows = raw(spark, {"message": "m", "service_id": "s", "format": "JSON"}, {"message": " \t", "service_id": "s"},
               {"message": None, "service_id": "", "format": "SYSLOG"})
    valid, invalid = ing.validate_raw(rows)
    assert valid.count() == 1
    assert [r.errors for r in invalid.orderBy(F.size("errors"), "format").collect()] == [
        {"message": "Log message cannot be blank", "format": "Format must be specified"},
        {"message": "Log message cannot be blank", "serviceId": "Service ID is required"},
    ]


def test_ingest_accounts_for_every_row(spark, sf):
    from sparklog.sources import tables as t

    rows, projects = t.raw_logs(spark, sf), t.projects(spark, sf)
    logs, errors = ing.ingest(rows, projects, T)
    assert logs.count() + errors.count() == rows.count()
    assert ing.resolve_tenant(rows, projects).count() + ing.unauthorized(rows, projects).count() == rows.count()
    assert logs.where("project_id = 99").count() == 0


def test_outcomes_fill_both_sinks_in_one_pass(spark, sf, tmp_path):
    from sparklog.sources import tables as t

    rows, projects = t.raw_logs(spark, sf), t.projects(spark, sf)
    sinks.write_outcomes(ing.ingest_outcomes(rows, projects, T), str(tmp_path / "out"))
    stored = spark.read.schema(schemas.INGEST_OUTCOME).parquet(str(tmp_path / "out"))
    logs, errors = ing.split_outcomes(stored)
    assert logs.count() + errors.count() == rows.count() and logs.columns == schemas.LOG_ENTRY.names
    accepted = ing.ingest_status(rows, projects, T).where("status = 'ACCEPTED'").select("id")
    assert accepted.exceptAll(logs.select("id")).isEmpty() and accepted.count() == logs.count()
    assert ing.ingest_errors(rows.drop("record_id"), projects).where("id <> 'unknown'").isEmpty()


def test_equal_records_are_different_records(spark, tmp_path):
    line = {"message": "up", "service_id": "s", "format": "PLAIN_TEXT", "timestamp": None}
    (tmp_path / "a.json").write_text((json.dumps(line) + "\n") * 3)
    (tmp_path / "b.json").write_text(json.dumps(line) + "\n")
    rows = readers.read_raw_logs(spark, str(tmp_path))
    assert rows.select("record_id").distinct().count() == 4
    assert ing.parse_logs(rows, T).select("id").distinct().count() == 4
    assert sorted(r.id for r in ing.parse_logs(rows, T).collect()) == sorted(r.id for r in ing.parse_logs(rows, T).collect())
    assert ing.parse_logs(rows.drop("record_id"), T).select("id").distinct().count() == 4
    nulls = rows.withColumn("record_id", F.lit(None).cast("string"))
    assert ing.parse_logs(nulls, T).select("id").distinct().count() == 4


def test_ids_stay_when_the_folder_grows_and_is_split_otherwise(spark, tmp_path):
    """Many splits per file, several files per task, blank lines, arrays and broken lines."""
    import random

    rng, sizes = random.Random(3), {}
    for name in "bdf":
        lines = [json.dumps({"message": f"{name}{i} " + "x" * rng.randint(0, 400), "service_id": "s"}) for i in range(700)]
        lines[5], lines[9], lines[11] = "", "{broken", "[" + json.dumps({"message": "one"}) + ", " + json.dumps({"message": "two"}) + "]"
        (tmp_path / f"{name}.json").write_text("\n".join(lines))
        sizes[name] = lines

    def ids():
        return {(r.message, r.record_id) for r in readers.read_raw_logs(spark, str(tmp_path)).collect()}

    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        first = ids()
        assert len(first) == len({i for _, i in first}) == 3 * 700
        for message, record_id in first:
            file, line = record_id.split(".json:")
            line, *nth = line.split(":")
            text = sizes[file[-1]][int(line)]
            assert message is None and text == "{broken" or message == ["one", "two"][len(nth)] or json.loads(text)["message"] == message
        for name in "ace":
            (tmp_path / f"{name}.json").write_text(json.dumps({"message": name}) + "\n")
        for size in ("20k", "3k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            again = ids()
            assert first <= again and len(again) == len(first) + 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_other_formats_have_places_too(spark, tmp_path):
    raw = spark.createDataFrame([{"message": f"m{i}", "service_id": "s"} for i in range(50)], schemas.LOG_RAW).coalesce(2)
    for fmt in ("csv", "parquet", "orc"):
        raw.write.format(fmt).save(str(tmp_path / fmt))
        rows = readers.read_raw_logs(spark, str(tmp_path / fmt), fmt)
        found = rows.select("message", "record_id").collect()
        assert {r.message for r in found} == {f"m{i}" for i in range(50)} and len({r.record_id for r in found}) == 50


def test_decode_log_events(spark):
    event = {"id": "e", "serviceId": "s", "level": "WARN", "message": "m", "timestamp": 1726480800.5, "projectId": 7}
    rows = texts(spark, json.dumps(event), "{broken", "12")
    good, bad = ing.decode_log_events(rows, "x", T)
    first, second = good.collect()
    assert (first.id, first.service_id, first.project_id, first.trace_id) == ("e", "s", 7, None)
    assert first.timestamp == dt.datetime(2024, 9, 16, 10, 0)
    assert (second.service_id, second.message, second.project_id, second.timestamp) == ("", "", None, T)
    assert [r.id for r in bad.collect()] == ["unknown"]


def test_sources_round_trip(spark, sf, tmp_path):
    from sparklog.sources import tables as t

    path = str(tmp_path / "raw")
    t.raw_logs(spark, sf).write.json(path)
    again = readers.read_raw_logs(spark, path, api_key="key-1")
    assert again.schema.names == [*schemas.LOG_RAW.names, "record_id"]
    assert again.where("api_key = 'key-1'").count() == t.raw_logs(spark, sf).count()

    projects = str(tmp_path / "projects")
    t.projects(spark, sf).write.parquet(projects)
    assert readers.read_dim(spark, "projects", projects).count() == t.projects(spark, sf).count()
    defs = str(tmp_path / "defs")
    t.custom_metrics(spark, sf).write.parquet(defs)
    assert readers.load_metric_defs(spark, defs).count() < 25

    keyed = sinks.keyed_logs(t.logs(spark, sf))
    good, bad = ing.decode_log_events(keyed, "value", T)
    same = good.join(t.logs(spark, sf).alias("l"), "id").where(
        (good.message == F.col("l.message")) & (good.timestamp == F.col("l.timestamp"))
    )
    assert same.count() == t.logs(spark, sf).count() and bad.count() == 0


def test_keyed_anomalies(spark, sf):
    from sparklog.operators import alerts as al
    from sparklog.plans.alert_queries import events

    found = events(spark, sf)
    keyed = sinks.keyed_anomalies(al.event_payload(found))
    again = al.normalize_anomalies(keyed, "value", T)
    assert keyed.columns == ["key", "value"]
    columns = ["event_id", "service_id", "severity", "timestamp", "deduplication_key"]
    assert again.select(columns).exceptAll(found.select(columns)).isEmpty() and again.count() == found.count()
