"""Batch and stream scans. Every reader has an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window

from sparklog import schemas
from sparklog.operators.joins import join_dim
from sparklog.operators.metrics import validate_metric_defs
from sparklog.session import scratch_dir

#: One row per file split: where it begins in its task, and how many rows it has.
SPLITS = schemas.table(_file="string", _block="long", _first="long", _rows="long")


def with_place(rows: DataFrame) -> DataFrame:
    """Rows of a file scan with ``_file`` and ``_line``, the number of the row in its own file.

    A first pass counts the rows of every file split and notes where the split begins in its task; the second one numbers the rows
    of a split from there and adds the rows of the file's earlier splits. The join partner has one row per split. The numbers
    do not depend on other files or on how files are split; should the two passes split the files differently, the second one fails.
    """
    spark = rows.sparkSession
    numbered = rows.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))
    path = scratch_dir(spark, "splits")
    numbered.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")).write.parquet(path)
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = spark.read.schema(SPLITS).parquet(path).withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    at = F.col("_row") - F.col("_first")
    line = F.when((at >= 0) & (at < F.col("_rows")), F.col("_before") + at).otherwise(
        F.raise_error("the files were split differently while they were read; read them again").cast("bigint"))
    return join_dim(numbered, splits, ["_file", "_block"], "left").withColumn("_line", line).drop(
        "_block", "_row", "_first", "_rows", "_before")


def read_raw_logs(
    spark: SparkSession, path: str, fmt: str = "json", api_key: str | None = None, traceparent: str | None = None
) -> DataFrame:
    """Raw records from JSON or CSV lines, or from another format whose files Spark can split; one key and one trace header for a whole
    batch override those of its records.

    ``record_id`` is the place of a record: its file and the number of its line (and its number in a JSON array of that line).
    Equal lines are different records, and a record keeps its id when files are added or split otherwise. CSV has no header.
    """
    if fmt in ("json", "csv"):
        lines = with_place(spark.read.text(path).select("value")).where(F.trim("value") != "")
        ddl = schemas.LOG_RAW
        if fmt == "json":
            parsed = lines.select("_file", "_line", F.posexplode_outer(F.from_json("value", ArrayType(ddl))).alias("_nth", "_record"))
        else:
            parsed = lines.select("_file", "_line", F.lit(0).alias("_nth"), F.from_csv("value", ddl.toDDL()).alias("_record"))
        raw = parsed.select("_record.*", F.concat_ws(":", "_file", "_line", F.when(F.col("_nth") > 0, F.col("_nth"))).alias("record_id"))
    else:
        raw = with_place(spark.read.schema(schemas.LOG_RAW).format(fmt).load(path)).withColumn(
            "record_id", F.concat_ws(":", "_file", "_line")).drop("_file", "_line")
    if api_key is not None:
        raw = raw.withColumn("api_key", F.lit(api_key))
    if traceparent is not None:
        raw = raw.withColumn("traceparent", F.lit(traceparent))
    return raw


def read_dim(spark: SparkSession, name: str, path: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A dimension table from Parquet, or from a database through JDBC options (``url``, ``user`` ...)."""
    if jdbc is not None:
        wanted = schemas.DIMENSIONS[name].fieldNames()
        return spark.read.format("jdbc").options(**{"dbtable": name, **jdbc}).load().select(*wanted)
    return spark.read.schema(schemas.DIMENSIONS[name]).parquet(path)


def load_metric_defs(spark: SparkSession, path: str) -> DataFrame:
    """Valid metric definitions. Called once per micro-batch, it follows changes of the table."""
    return validate_metric_defs(read_dim(spark, "custom_metrics", path))[0]


def _stream(spark: SparkSession, source: str | dict[str, str], schema: StructType, fmt: str, **options) -> DataFrame:
    if isinstance(source, dict):  # Kafka options: kafka.bootstrap.servers, subscribe ...
        kafka = spark.readStream.format("kafka").options(**source).load()
        return kafka.select(
            F.concat_ws(":", "topic", "partition", "offset").alias("record_id"),
            F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived_at"),
        )
    reader = spark.readStream.schema(schema).format(fmt)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(source)


def stream_logs(
    spark: SparkSession, source: str | dict[str, str], schema: StructType = schemas.LOG_ENTRY,
    fmt: str = "parquet", **options,
) -> DataFrame:
    """Log stream: Kafka options give JSON text in ``value``, a folder gives typed rows."""
    return _stream(spark, source, schema, fmt, **options)


def stream_anomalies(spark: SparkSession, source: str | dict[str, str], **options) -> DataFrame:
    """Anomaly stream as JSON text in ``value``, from Kafka or from a folder of text files."""
    return _stream(spark, source, schemas.table(value="string"), "text", **options)
