"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Keys that hold at least this share of all rows count as hot, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


#: The temporary base of this process where the session has no shared folder, and the run folders that are open.
_LOCAL: list[str] = []
_OPEN: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, or inside the open run folder; in local mode without that setting, a
    temporary one. The setting itself is not changed."""
    base = _OPEN[-1] if _OPEN else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='llm-')}")
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables that are written inside are removed at the end; what is kept is written to a folder chosen before."""
    folder = shared_folder(spark, "run")
    _OPEN.append(folder)
    try:
        yield folder
    finally:
        _OPEN.remove(folder)
        remove(spark, folder)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read again: computed once, and no lost executor repeats its lineage."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_of(frame: DataFrame) -> Column:
    """The text, null as the empty string."""
    return F.coalesce(frame["text"], F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_counted(facts: DataFrame, keyed: DataFrame, key: str, count: str, total: int,
                 share: float = HOT_SHARE) -> DataFrame:
    """Inner join of many ``facts`` with one ``keyed`` row per key, of which ``count`` tells the key's number of facts.

    Keys with ``share`` of the ``total`` facts or more are at most 1 / share rows, so they are broadcast and their
    facts stay where they are; all the others are joined by a shuffle in which no key is large.
    """
    least = max(2, int(total * share))
    hot = F.broadcast(keyed.filter(F.col(count) >= least))
    cold = keyed.filter(F.col(count) < least)
    spared = facts.join(hot.select(key), key, "left_anti")
    return facts.join(hot, key).unionByName(spared.join(cold, key))
