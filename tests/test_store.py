"""The store: commits, merges, replays, expiry, and stops at every step."""

from __future__ import annotations

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparklog import schemas
from sparklog.operators import retention
from sparklog.sources import sinks, store as st
from sparklog.sources.store import Store
from sparklog.streaming import jobs

ROWS = schemas.table(k="long", at="timestamp", n="long")
START = dt.datetime(2026, 1, 1)


def rows(spark, *values):
    return spark.createDataFrame([(k, None if h is None else START + dt.timedelta(hours=h), n) for k, h, n in values], ROWS).coalesce(1)


def held(store, **days):
    return sorted((r.k, r.n) for r in store.read(**days).collect())


def on_disk(path) -> int:
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


def test_files_stay_bounded_and_results_equal(spark, tmp_path):
    """60 micro-batches over five days: a batch's look-back opens a bounded number of files, and nothing is lost."""
    store = Store(spark, str(tmp_path / "s"), ROWS, "at", ["k", "at"], "latest")
    want, most = {}, 0
    for i in range(60):
        hour = i * 2
        values = [(1, hour, i), (2, hour - hour % 24, i), (3, max(hour - 24, 0), i)]
        want |= {(k, h): n for k, h, n in values}
        assert store.commit(rows(spark, *values), i, app="a")
        most = max(most, store.files(since=(START + dt.timedelta(hours=hour - 24)).date()))
    assert most <= 2 * 2 * st.FANOUT
    assert held(store) == sorted((k, n) for (k, _), n in want.items())
    newest = held(store, since=dt.date(2026, 1, 5))
    assert newest == sorted((k, n) for (k, h), n in want.items() if h >= 96)
    before = on_disk(tmp_path)
    assert store.expire(dt.date(2026, 1, 4)) == 3
    assert held(store) == sorted((k, n) for (k, h), n in want.items() if h >= 72)
    assert on_disk(tmp_path) < before and not list(Path(tmp_path).rglob("log_date=2026-01-02"))
    assert len(list((tmp_path / "s" / "_manifest").glob("*.json"))) <= st.GRACE


def test_a_batch_counts_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ROWS, "at", ["k", "at"], "sum")
    for i in range(10):
        assert store.commit(rows(spark, (1, 0, 1), (2, i, 5)), i, app="a")
        assert not store.commit(rows(spark, (1, 0, 100)), i, app="a")
    assert store.commit(rows(spark, (1, 0, 7)), 0, app="another stream")
    assert held(store)[0] == (1, 17)
    assert store.commit(rows(spark), 10, app="a") and held(store)[0] == (1, 17)
    with pytest.raises(ValueError, match="appends"):
        store.commit(rows(spark), "name")


def test_named_batches_replace_themselves_also_when_merged(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ROWS, "at")
    for i in range(st.FANOUT + 2):
        store.commit(rows(spark, (i, 0, 0), (i, 30, 0), (i, None, 0)), f"b{i}")
    store.commit(rows(spark, (3, 0, 1)), "b3")  # it has lost two days
    want = [(i, 0) for i in range(st.FANOUT + 2) if i != 3 for _ in range(3)] + [(3, 1)]
    assert held(store) == sorted(want)
    assert held(store, days=[None]) == [(i, 0) for i in range(st.FANOUT + 2) if i != 3]


def test_rows_without_a_day_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ROWS, "at")
    store.commit(rows(spark, (1, None, 1), (2, 0, 2)), 0, app="a")
    store.expire(dt.date(2030, 1, 1))
    assert held(store) == [(1, 1)] == held(store, days=[None])


@pytest.mark.parametrize("step", ["_write", "_publish", "_remove"])
@pytest.mark.parametrize("done", [False, True])
def test_a_purge_that_stops_loses_nothing(spark, tmp_path, monkeypatch, step, done):
    """Stopped before or after each step of its two changes; the next call ends the purge."""
    path, as_of = str(tmp_path / "docs"), dt.datetime(2024, 1, 31, 13, 30)
    times = ["2024-01-20 10:00", "2024-01-24 13:00", "2024-01-24 14:00", "2024-01-30 00:00", None]
    docs = spark.createDataFrame([(f"d{i}", 1, t) for i, t in enumerate(times)], "id string, project_id long, timestamp string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))
    sinks.write_documents(docs, path, "a")
    real = getattr(Store, step)
    for stop_at in (0, 1):
        calls = []

        def stopped(self, *args):
            calls.append(step)
            if len(calls) > stop_at:
                if done:
                    real(self, *args)
                raise OSError("stopped")
            return real(self, *args)

        monkeypatch.setattr(Store, step, stopped)
        try:
            retention.purge_documents(spark, path, as_of)
        except OSError:
            pass
        monkeypatch.setattr(Store, step, real)
        left = {r.id for r in sinks.read_documents(spark, path).collect()}
        assert {"d2", "d3", "d4"} <= left
    retention.purge_documents(spark, path, as_of)
    assert {r.id for r in sinks.read_documents(spark, path).collect()} == {"d2", "d3", "d4"}
    sinks.documents_store(spark, path).vacuum()
    assert sinks.read_documents(spark, path).count() == 3


def test_a_second_writer_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ROWS, "at")
    old = store.manifest()
    store.commit(rows(spark, (1, 0, 1)), 0, app="a")
    with pytest.raises(st.ConcurrentCommit):
        store._publish(st.Manifest(old.number + 1))
    assert held(store) == [(1, 1)]


def test_index_reads_only_the_days_it_touches(spark, tmp_path):
    path, schema = str(tmp_path / "docs"), schemas.LOG_DOCUMENT

    def docs(*values):
        return spark.createDataFrame([(i, "s", "INFO", 1, "m", None if d is None else START + dt.timedelta(days=d), None, None, None)
                                      for i, d in values], schema)

    store = sinks.documents_store(spark, path)
    for batch, values in enumerate(([("a", 0), ("b", 1)], [("c", 2), ("n", None)], [("a", 0), ("d", 2), ("n", None), ("b", 0)])):
        fresh = jobs.unstored(docs(*values), store)
        store.commit(fresh, batch, app="a")
    stored = sorted((r.id, r.log_date) for r in sinks.read_documents(spark, path).collect() if r.log_date)
    day = START.date()
    assert stored == [("a", day), ("b", day), ("b", day + dt.timedelta(1)), ("c", day + dt.timedelta(2)), ("d", day + dt.timedelta(2))]
    assert sinks.read_documents(spark, path).where("log_date is null").count() == 1
    opened = [f for f in jobs.unstored(docs(("x", 2), ("y", None)), store).inputFiles() if "run=" in f]
    assert opened and {f.split("log_date=")[1].split("/")[0] for f in opened} == {"2026-01-03", st.NO_DAY}


def test_files_carry_bloom_filters(spark, tmp_path, monkeypatch):
    docs = spark.range(2000).selectExpr(
        "cast(id as string) as id", "'s' as service_id", "'INFO' as level", "1L as project_id", "'m' as message",
        "timestamp'2026-01-01 00:00:00' as timestamp", "concat('t', id) as trace_id", "'x' as span_id", "'y' as parent_span_id")
    sinks.write_documents(docs, str(tmp_path / "with"), 0)
    monkeypatch.setattr(st, "BLOOM", ())
    sinks.write_documents(docs, str(tmp_path / "without"), 0)
    sizes = [sum(f.stat().st_size for f in (tmp_path / name).rglob("*.parquet")) for name in ("with", "without")]
    assert sizes[0] > sizes[1] + 2000  # two filters of a byte or more per value
    assert sinks.read_documents(spark, str(tmp_path / "with")).where("trace_id = 't77'").count() == 1


def test_token_search_opens_only_matching_files(spark, tmp_path):
    """Same rows as a scan; files of other days and words stay closed, new and merged runs are found, expired ones go."""
    from sparklog.operators.search import search_logs
    from sparklog.sources import token_index as ti

    path = str(tmp_path / "docs")

    def write(batch, *values):
        rows = [(i, "s", "INFO", p, m, START + dt.timedelta(days=d), None, None, None) for i, p, m, d in values]
        sinks.write_documents(spark.createDataFrame(rows, schemas.LOG_DOCUMENT), path, batch)

    write(1, *[(f"a{i}", 1, f"plain words {i}", i) for i in range(6)], ("x", 1, "the Firewall-blocked it", 2), ("y", 2, "firewall", 4))
    assert ti.update_postings(spark, path) == 6 and ti.update_postings(spark, path) == 0
    for query, project, days in (("fire", 1, {2}), ("WALL", 2, {4}), ("plain", 1, set(range(6))), ("nothing", 1, set()), ("d_b", 1, set())):
        found = ti.search_indexed(spark, path, project, query)
        opened = {f.split("log_date=")[1][:10] for f in found.inputFiles() if "log_date=" in f}
        assert opened == {(START + dt.timedelta(days=d)).date().isoformat() for d in days}
        want = search_logs(sinks.read_documents(spark, path), project, query, "token")
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want.collect())
    write(2, ("z", 1, "wildfire", 5), ("n", 1, None, 5))
    assert sorted(r.id for r in ti.search_indexed(spark, path, 1, "fire").collect()) == ["x", "z"]
    assert ti.update_postings(spark, path) > 0
    sinks.documents_store(spark, path).expire((START + dt.timedelta(days=3)).date())
    assert [r.id for r in ti.search_indexed(spark, path, 1, "fire").collect()] == ["z"]
    assert ti.search_indexed(spark, path, 1, "wild-fire").isEmpty()
    with pytest.raises(ValueError, match="blanks"):
        ti.search_indexed(spark, path, 1, "two words")
