"""Retention: filters that keep the fresh rows, and removal of old partitions on disk."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.functions.clock import instant, shift, width_seconds
from sparklog.operators.ingest import When
from sparklog.sources.sinks import documents_store


def expire(df: DataFrame, ts_col: str, as_of: When, keep: str) -> DataFrame:
    """Rows not older than ``keep`` (for example ``"25 hours"``)."""
    return df.where(F.col(ts_col) >= shift(instant(as_of), -width_seconds(keep)))


def apply_retention(docs: DataFrame, as_of: When, days: int = 7) -> DataFrame:
    """Documents that stay: those before ``as_of - days`` are removed."""
    return expire(docs, "timestamp", as_of, f"{days} days")


def purge_documents(spark: SparkSession, path: str, as_of: dt.datetime, days: int = 7) -> dict[str, int]:
    """Apply the retention to a document store written by ``write_documents``, while nobody else writes to it.

    Whole days before the cut go unread. Of the boundary day the fresh rows are written as a new run, which takes the old ones'
    place in one step, the next manifest; a purge that stops anywhere leaves every fresh row in the store. Documents
    without a timestamp stay.
    """
    cut = as_of - dt.timedelta(days=days)
    store = documents_store(spark, path)
    dropped = store.expire(cut.date())
    rewritten = store.rewrite(cut.date(), F.col("timestamp") >= instant(cut), order=["project_id", "timestamp"])
    return {"dropped": dropped, "rewritten": int(rewritten)}
