"""Plans and skew: what must hold when the data is large."""

from __future__ import annotations

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from sparklog.operators import anomaly as an
from sparklog.operators import delivery as de
from sparklog.operators import ingest as ing
from sparklog.operators import joins, metrics, retention, search
from sparklog.sources import sinks
from sparklog.sources import tables as t


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, some have none."""
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
        F.create_map(F.lit("a"), F.col("id")).alias("m"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    dim = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = skewed.join(dim, "k", how)
    columns = sorted(c for c in plain.columns if c != "m")
    want = sorted(map(str, plain.select(*columns).collect()))
    for cap in (0, 100):
        got = joins.join_dim(skewed, dim, ["k"], how, max_rows=cap)
        assert sorted(c for c in got.columns if c != "m") == columns
        assert sorted(map(str, got.select(*columns).collect())) == want
    assert "BroadcastHashJoin" in plan(joins.join_dim(skewed, dim, ["k"], how))


def test_salting_spreads_the_hot_key(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dim = spark.range(30).select(F.col("id").alias("k"))
        joined = joins.join_dim(skewed, dim, ["k"], max_rows=0)
        assert "_salt" in plan(joined)
        tasks = joined.where("k = 7").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_large_dimension_is_not_broadcast(spark, skewed, tmp_path, how):
    """Neither by Spark's estimate, which knows the file but not its copies for the salts, nor when stages are planned anew."""
    path = str(tmp_path / "dim")
    spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).write.parquet(path)
    joined = joins.join_dim(skewed.drop("m"), spark.read.parquet(path), ["k"], how, max_rows=0)
    assert "SortMergeJoin" in plan(joined) and "Broadcast" not in plan(joined)
    joined.collect()
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_ingest_with_many_projects_broadcasts_none(spark, sf, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    logs, errors = ing.ingest(t.raw_logs(spark, sf), t.projects(spark, sf), t.AS_OF)
    assert "Broadcast" not in plan(logs) + plan(errors)


def test_broadcast_is_measured(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("x"))
    assert joins.fits_broadcast(wide)
    assert not joins.fits_broadcast(wide, max_rows=9)
    assert not joins.fits_broadcast(wide, max_bytes=5000)
    assert joins.fits_broadcast(spark.range(0))


def test_ingest_does_not_shuffle(spark, sf):
    logs, errors = ing.ingest(t.raw_logs(spark, sf), t.projects(spark, sf), t.AS_OF)
    for df in (logs, errors):
        text = plan(df)
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
        assert "Python" not in text


def test_filters_and_columns_reach_the_scan(spark, sf, tmp_path):
    path = str(tmp_path / "docs")
    sinks.write_documents(search.to_log_documents(t.logs(spark, sf), dedup=False), path, 0)
    docs = sinks.read_documents(spark, path)
    text = plan(search.search_by_service(docs, 2, "svc-1").select("id"))
    assert "EqualTo(project_id,2)" in text
    assert "EqualTo(service_id,svc-1)" in text and "message" not in text.split("ReadSchema")[1]


def test_counts_are_combined_before_the_shuffle(spark, sf):
    text = plan(metrics.minute_counts(t.logs(spark, sf)))
    assert text.count("HashAggregate") >= 2 and text.count("Exchange hashpartitioning") <= 2


def test_top_rows_are_cut_before_the_shuffle(spark, sf):
    text = plan(de.due_deliveries(t.deliveries(spark, sf), t.ORDERS_AS_OF))
    assert text.count("WindowGroupLimit") >= 6


def test_top_per_group_equals_a_full_ranking(spark, skewed):
    ranked = joins.top_per_group(skewed.drop("m").repartition(9), ["k"], [F.col("id").desc()], 5, splits=3)
    got = {(r.k, r.id, r.rank) for r in ranked.collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.k, []).append(r.id)
    assert got == {(k, v, i + 1) for k, ids in groups.items() for i, v in enumerate(sorted(ids, reverse=True)[:5])}


def test_backfill_sorts_bucket_rows_once_per_shuffle(spark, sf):
    counts = metrics.minute_counts(t.logs(spark, sf), "1 hour")
    text = plan(an.volume_anomalies_backfill(counts, t.AS_OF, width="1 hour", lookback="7 days"))
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") == 2 and tree.count("Sort") == 2 and "_chunk" in text


def test_detectors_read_the_events_once(spark, sf):
    """What follows from the counters reads no events, however many detectors and look-ups there are."""
    from sparklog.plans import queries

    for name in ("all_anomalies", "enqueue_deliveries", "fan_out"):
        assert not [f for f in queries()[name](spark, sf).inputFiles() if "events" in f], name


def test_hot_trace_is_one_row(spark):
    docs = spark.range(5000).select(
        F.col("id").cast("string").alias("id"), F.lit("s").alias("service_id"), F.lit("INFO").alias("level"),
        F.lit(1).cast("long").alias("project_id"), F.lit("m").alias("message"),
        F.timestamp_seconds("id").alias("timestamp"), F.lit("hot").alias("trace_id"),
    )
    assert search.trace_groups(docs).first().records == 5000
    assert search.trace_preview(docs).first().id == "0"
    text = plan(search.trace_groups(docs))
    assert text.split("Exchange")[0].count("Aggregate") >= 1 and text.count("SortAggregate") >= 2


def test_retention_on_disk(spark, sf, tmp_path):
    path = str(tmp_path / "docs")
    docs = search.to_log_documents(t.logs(spark, sf), dedup=False)
    sinks.write_documents(docs, path, 0)
    as_of = dt.datetime(2024, 1, 31, 13, 30)
    report = retention.purge_documents(spark, path, as_of)
    assert report["dropped"] > 0 and report["rewritten"] > 0
    left = sinks.read_documents(spark, path)
    kept = retention.apply_retention(docs, as_of)
    assert sorted(r.id for r in left.collect()) == sorted(r.id for r in kept.collect())
    assert retention.purge_documents(spark, path, as_of)["dropped"] == 0


def test_retention_keeps_fresh_documents_without_a_project(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [("old", 1, "2024-01-24 13:00:00"), ("a", None, "2024-01-24 14:00:00"), ("b", 1, "2024-01-24 15:00:00"),
            ("none", None, None)]
    docs = spark.createDataFrame(rows, "id string, project_id long, timestamp string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))
    as_of = dt.datetime(2024, 1, 31, 13, 30)
    for batch in (1, 2):
        sinks.write_documents(docs.withColumn("id", F.concat("id", F.lit(batch))), path, batch)
    assert sinks.read_documents(spark, path).count() == 8
    assert retention.purge_documents(spark, path, as_of) == {"dropped": 0, "rewritten": 1}
    left = sorted(r.id for r in sinks.read_documents(spark, path).collect())
    assert left == ["a1", "a2", "b1", "b2", "none1", "none2"]
    assert retention.purge_documents(spark, path, as_of + dt.timedelta(days=1)) == {"dropped": 1, "rewritten": 0}


def test_document_writes_are_repeatable(spark, sf, tmp_path):
    path = str(tmp_path / "docs")
    docs = search.to_log_documents(t.logs(spark, sf))
    for _ in range(2):
        sinks.write_documents(docs, path, "a")
    assert sinks.read_documents(spark, path).count() == docs.count()
