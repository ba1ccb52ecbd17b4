"""A log-structured table: immutable runs by day, and a manifest that names the runs in force.

A commit writes one new run and then publishes the next manifest, a small file; readers see a commit whole or not at all.
Runs of a day are merged when there are ``FANOUT`` of one level, and when the day is over, so a day has a bounded number of
runs however many commits it had. Rewriting or expiring a day is a new manifest too: until it is published the old runs
count, afterwards the new ones. What a manifest lets go is removed from disk a few commits later, or at once by ``expire``.

Layout: ``run=SEQUENCE-ID/log_date=DAY/*.parquet`` and ``_manifest/NUMBER.json``. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FANOUT = 8
#: Manifests that stay readable, and commits after which the files of a replaced run go.
GRACE = 4
#: Columns whose files carry a Bloom filter, so that a search for a value skips the row groups without it.
BLOOM = ("id", "trace_id")
#: The folder name of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class ConcurrentCommit(RuntimeError):
    """Another writer has published the manifest that this commit was about to publish."""


@dataclass
class Manifest:
    """``runs``: path, day, level and named batches of each run of a day; ``done``: last batch by application;
    ``meta``: values that were committed together with rows; ``garbage``: paths let go and since when."""

    number: int = 0
    runs: list[dict] = field(default_factory=list)
    done: dict[str, int] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    garbage: list[list] = field(default_factory=list)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of every key."""
    values = [c for c in rows.columns if c not in (*keys, "version", "log_date")]
    newest = rows.groupBy("log_date", *keys).agg(F.max_by(F.struct(*values), "version").alias("_row"), F.max("version").alias("version"))
    return newest.select("log_date", *keys, *[F.col(f"_row.{c}").alias(c) for c in values], "version")


def added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of every key's values."""
    values = [c for c in rows.columns if c not in (*keys, "version", "log_date", "batch")]
    return rows.groupBy("log_date", *keys).agg(
        *[F.sum(c).alias(c) for c in values], F.max("batch").alias("batch"), F.max("version").alias("version"))


MERGES: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {"append": lambda rows, _: rows, "latest": latest, "sum": added}


@dataclass
class Store:
    """A table of ``schema`` whose rows have the day of ``ts_col``.

    ``merge``: ``append`` keeps all rows, ``latest`` the newest committed row of each key, ``sum`` adds the values of a key.
    Rows of a key must be of one day.
    """

    spark: SparkSession
    path: str
    schema: StructType
    ts_col: str
    keys: list[str] = field(default_factory=list)
    merge: str = "append"

    # --- files --------------------------------------------------------------------------------------------

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, name: str) -> list[str]:
        folder = self._at(name)
        return [s.getPath().getName() for s in self._fs().listStatus(folder)] if self._fs().exists(folder) else []

    def manifest(self) -> Manifest:
        """The newest published manifest."""
        numbers = [int(n[:-5]) for n in self._names("_manifest") if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return Manifest()
        stream = self._fs().open(self._at(f"_manifest/{max(numbers):012d}.json"))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, new: Manifest) -> None:
        """Writes the manifest beside its place and moves it there; then removes what is past its grace."""
        fs, place = self._fs(), self._at(f"_manifest/{new.number:012d}.json")
        due = [path for at, path in new.garbage if new.number - at >= GRACE]
        new.garbage = [[at, path] for at, path in new.garbage if new.number - at < GRACE]
        staged = self._at(f"_manifest/_{uuid.uuid4().hex}")
        stream = fs.create(staged, True)
        try:
            stream.write(bytearray(json.dumps(new.__dict__).encode()))
        finally:
            stream.close()
        if fs.exists(place) or not fs.rename(staged, place):
            fs.delete(staged, False)
            raise ConcurrentCommit(str(place))
        old = self._at(f"_manifest/{new.number - GRACE:012d}.json")
        if fs.exists(old):
            fs.delete(old, False)
        self._remove(due)

    def _remove(self, paths: Iterable[str]) -> None:
        """Removes the days of runs, and runs that have no day left."""
        fs = self._fs()
        for path in paths:
            fs.delete(self._at(path), True)
            run = path.split("/")[0]
            if not any(n.startswith("log_date=") for n in self._names(run)):
                fs.delete(self._at(run), True)

    # --- reading ------------------------------------------------------------------------------------------

    def columns(self) -> StructType:
        return StructType([*self.schema.fields]).add("version", "long").add("batch", "string").add("log_date", "date")

    def load(self, runs: list[dict]) -> DataFrame:
        """The rows of runs, or of files of runs, given by their ``path`` in the store."""
        if not runs:
            return self.spark.createDataFrame([], self.columns())
        paths = [f"{self.path}/{r['path']}" for r in runs]
        return self.spark.read.schema(self.columns()).option("basePath", self.path).parquet(*paths).drop("run")

    def _chosen(self, days: Iterable[dt.date | None] | None, since: dt.date | None) -> list[dict]:
        wanted = None if days is None else {NO_DAY if d is None else d.isoformat() for d in days}
        return [r for r in self.manifest().runs if (wanted is None or r["day"] in wanted) and (
            since is None or r["day"] == NO_DAY or r["day"] >= since.isoformat())]

    def versions(self, days: Iterable[dt.date | None] | None = None, since: dt.date | None = None) -> DataFrame:
        """The stored rows with ``version`` (the commit), ``batch`` and ``log_date``; only the chosen days are listed and read."""
        return self.load(self._chosen(days, since))

    def read(self, days: Iterable[dt.date | None] | None = None, since: dt.date | None = None) -> DataFrame:
        """The table: rows merged by key, without the columns of the store."""
        return MERGES[self.merge](self.versions(days, since), self.keys).select(*self.schema.fieldNames())

    def with_own_schema(self) -> Store:
        """This store with the schema of its first commit, if it has one."""
        own = self.meta("schema")
        return self if own is None else replace(self, schema=StructType.fromJson(own))

    def meta(self, name: str, default=None):
        return self.manifest().meta.get(name, default)

    def files(self, days: Iterable[dt.date | None] | None = None, since: dt.date | None = None) -> int:
        """Files that a read of these days opens."""
        return len(self.versions(days, since).inputFiles())

    # --- writing ------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, number: int, order: list[str], gather: bool = True) -> list[str]:
        """A new run of ``rows``, which carry the store's columns; its days' paths. Without ``gather`` every task writes its own files."""
        name = f"run={number:012d}-{uuid.uuid4().hex[:8]}"
        rows = rows.select(*self.columns().fieldNames())
        if gather:
            rows = rows.hint("rebalance", "log_date", *order[:1])
        writer = rows.sortWithinPartitions("log_date", *order).write
        for column in BLOOM:
            if column in self.schema.fieldNames():
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.partitionBy("log_date").parquet(f"{self.path}/{name}")
        days = [f"{name}/{n}" for n in self._names(name) if n.startswith("log_date=")]
        if not days:
            self._fs().delete(self._at(name), True)
        return days

    def commit(
        self, rows: DataFrame, batch: int | str, app: str | None = None, meta: dict | None = None, snapshot: bool = False,
        order: list[str] | None = None, gather: bool = True,
    ) -> bool:
        """Adds the rows of a batch; returns whether they were new.

        With ``app``, batches are numbered: one that is not after the last committed batch of this application is already
        in the table and is passed over, so a micro-batch that is run again counts once. Without, ``batch`` is a name, and a batch
        written again replaces the rows that it had, on whatever days. ``snapshot`` replaces the whole table. Rows of one day need no
        shuffle before they are written (``gather=False``); a merge gathers their files later.
        """
        if app is None and not snapshot and self.merge != "append":
            raise ValueError("a named batch can only be replaced in a table that appends")
        old = self.manifest()
        if app is not None and old.done.get(app, -1) >= int(batch):
            return False
        new = Manifest(old.number + 1, [*old.runs], {**old.done},
                       {"schema": self.schema.jsonValue(), **old.meta, **(meta or {})}, [*old.garbage])
        dated = rows.select(*self.schema.fieldNames(), F.lit(new.number).cast("long").alias("version"), F.lit(str(batch)).alias("batch"),
                            F.to_date(self.ts_col).alias("log_date"))
        fresh = self._write(dated, new.number, order or [], gather)
        replaced = old.runs if snapshot else [r for r in old.runs if app is None and str(batch) in r["batches"]]
        shared = [r for r in replaced if not snapshot and r["batches"] != [str(batch)]]
        for r in replaced:
            new.runs.remove(r)
        if shared:  # the batch lies in merged runs: the others' rows are written again without it
            others = self.load(shared).where(F.col("batch") != str(batch))
            kept = {p.split("=")[-1]: p for p in self._write(others, new.number, order or [])}
            new.runs += [{**r, "path": kept[r["day"]], "batches": [b for b in r["batches"] if b != str(batch)]}
                         for r in self._by_day(shared) if r["day"] in kept]
        named = [] if app is not None else [str(batch)]
        new.runs += [{"path": p, "day": p.split("=")[-1], "level": 0, "batches": named} for p in fresh]
        new.garbage += [[new.number, r["path"]] for r in replaced]
        if app is not None:
            new.done[app] = int(batch)
        self._publish(new)
        self.compact({r["day"] for r in old.runs}, order)
        return True

    @staticmethod
    def _by_day(runs: list[dict]) -> list[dict]:
        """One entry per day for runs that were written as one."""
        days: dict[str, dict] = {}
        for r in runs:
            one = days.setdefault(r["day"], {**r, "batches": []})
            one["batches"] = sorted({*one["batches"], *r["batches"]})
            one["level"] = max(one["level"], r["level"])
        return list(days.values())

    def compact(self, known: set[str] | None = None, order: list[str] | None = None) -> int:
        """Merges the runs of days that have ``FANOUT`` runs of a level, and of days that ended with the last commit.

        ``known`` are the days of the table before that commit. Returns the number of runs that were merged.
        """
        old = self.manifest()
        days = defaultdict(list)
        for r in old.runs:
            days[r["day"]].append(r)
        newest = max((d for d in days if d != NO_DAY), default="")
        over = bool(known) and newest > max((d for d in known if d != NO_DAY), default="")
        chosen: list[dict] = []
        for day, runs in days.items():
            if over and day != newest and len(runs) > 1:
                chosen += runs
                continue
            full = [level for level, n in Counter(r["level"] for r in runs).items() if n >= FANOUT]
            chosen += [r for r in runs if full and r["level"] == min(full)]
        if not chosen:
            return 0
        new = Manifest(old.number + 1, [r for r in old.runs if r not in chosen], old.done, old.meta, [*old.garbage])
        merged = MERGES[self.merge](self.load(chosen), self.keys)
        paths = {p.split("=")[-1]: p for p in self._write(merged, new.number, order or [])}
        new.runs += [{**r, "path": paths[r["day"]], "level": r["level"] + 1} for r in self._by_day(chosen) if r["day"] in paths]
        new.garbage += [[new.number, r["path"]] for r in chosen]
        self._publish(new)
        return len(chosen)

    def rewrite(self, day: dt.date, keep: Column, order: list[str] | None = None) -> bool:
        """Keeps only some rows of a day; returns whether the table has the day. Stopped before its last step, the day is as it was."""
        old = self.manifest()
        runs = [r for r in old.runs if r["day"] == day.isoformat()]
        if not runs:
            return False
        new = Manifest(old.number + 1, [r for r in old.runs if r not in runs], old.done, old.meta, [*old.garbage])
        paths = self._write(self.load(runs).where(keep), new.number, order or [])
        new.runs += [{**r, "path": p} for p in paths for r in self._by_day(runs)]
        new.garbage += [[new.number, r["path"]] for r in runs]
        self._publish(new)
        return True

    def expire(self, before: dt.date) -> int:
        """Takes the days before ``before`` out of the table and off the disk, unread; returns their number."""
        old = self.manifest()
        runs = [r for r in old.runs if r["day"] != NO_DAY and r["day"] < before.isoformat()]
        gone = [[at, p] for at, p in old.garbage if NO_DAY not in p and p.split("=")[-1] < before.isoformat()]
        if not runs and not gone:
            return 0
        self._publish(Manifest(old.number + 1, [r for r in old.runs if r not in runs], old.done, old.meta,
                               [g for g in old.garbage if g not in gone]))
        self._remove([*[r["path"] for r in runs], *[p for _, p in gone]])
        return len({r["day"] for r in runs})

    def vacuum(self) -> int:
        """Removes runs that no manifest names: those of commits that were stopped. Returns their number."""
        known = self.manifest()
        used = {p.split("/")[0] for p in [*[r["path"] for r in known.runs], *[p for _, p in known.garbage]]}
        left = [n for n in self._names("") if n.startswith("run=") and n not in used]
        for name in left:
            self._fs().delete(self._at(name), True)
        return len(left)
