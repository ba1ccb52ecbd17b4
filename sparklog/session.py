"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    # All times are instants; buckets and dates are UTC.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: partition sizes, and splitting of skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A JSON record with a repeated key keeps the last value instead of counting as broken.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Only the touched partitions are replaced by an overwrite.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The JVM does not compile methods above this size; Spark then splits the generated code instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # State lives on disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "sparklog", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers once, unless they find it where the driver does (PYTHONPATH or working folder)."""
    root = Path(__file__).resolve().parents[1]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    sent = any("sparklog-" in str(f) for f in spark.sparkContext._python_includes)
    if not sent and not any(p and Path(p).resolve() == root for p in known):
        name = Path(tempfile.mkdtemp()) / f"sparklog-{os.getpid()}"
        spark.sparkContext.addPyFile(shutil.make_archive(str(name), "zip", root, "sparklog"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name for one run, under the shared folder of ``spark.checkpoint.dir``.

    A local temporary folder is used only in local mode and only where that setting is missing (tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="sparklog-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
