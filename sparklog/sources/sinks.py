"""Sinks. Batch writes are replaceable: running one again gives the same files, not more rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparklog import schemas
from sparklog.sources.store import Store

_CAMEL_LOG = {
    "id": "id", "timestamp": "timestamp", "service_id": "serviceId", "level": "level", "message": "message",
    "host": "host", "metadata": "metadata", "tags": "tags", "raw_log": "rawLog",
    "ingestion_timestamp": "ingestionTimestamp", "project_id": "projectId", "trace_id": "traceId",
    "span_id": "spanId", "parent_span_id": "parentSpanId",
}


def keyed_logs(logs: DataFrame) -> DataFrame:
    """``key`` (project:service) and ``value`` (JSON event, times to the microsecond), the form of a message topic."""
    fields = [F.col(c).alias(name) for c, name in _CAMEL_LOG.items() if c in logs.columns]
    return logs.select(F.concat_ws(":", "project_id", "service_id").alias("key"), F.to_json(
        F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def keyed_anomalies(events: DataFrame) -> DataFrame:
    """``key`` (service) and ``value`` (JSON event); ``events`` carry a ``payload``."""
    return events.select(F.col("service_id").alias("key"), F.col("payload").alias("value"))


def write_keyed(keyed: DataFrame, kafka: dict[str, str]) -> None:
    """Send key/value rows to a topic (options ``kafka.bootstrap.servers``, ``topic``)."""
    keyed.write.format("kafka").options(**kafka).save()


def documents_store(spark: SparkSession, path: str, schema: StructType = schemas.LOG_DOCUMENT) -> Store:
    """The store of :func:`write_documents`; once written, it has the schema of its first commit."""
    return Store(spark, path, schema, "timestamp").with_own_schema()


def write_documents(docs: DataFrame, path: str, batch: int | str) -> None:
    """Adds the documents of a batch to the store, by day; the same batch written again replaces all that it had.

    The rows of a project lie side by side: the rebalance hint splits a hot project over several files, and the sort lets a
    filter on the project skip the others' row groups. Files carry Bloom filters of ids and trace ids.
    """
    documents_store(docs.sparkSession, path, docs.schema).commit(docs, batch, order=["project_id", "timestamp"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents in force, with their ``log_date``."""
    return documents_store(spark, path).versions().drop("version", "batch")


write_logs = write_documents


def write_outcomes(outcomes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Logs and errors of ``ingest_outcomes`` in one pass, as the folders ``outcome=logs`` and ``outcome=errors``."""
    writer = outcomes.write.mode(mode).option("partitionOverwriteMode", "static")
    writer.partitionBy("outcome").parquet(path)


def write_errors(errors: DataFrame, path: str, mode: str = "append") -> None:
    errors.write.mode(mode).parquet(path)
