"""Registered queries: every operator as a Spark plan over the test tables, next to its check SQL."""

from __future__ import annotations

from sparklog.plans import alert_queries, anomaly_queries, ingest_queries, metric_queries, search_queries, stream_queries  # noqa: F401
from sparklog.plans.registry import oracle_sql, queries

__all__ = ["queries", "oracle_sql"]
