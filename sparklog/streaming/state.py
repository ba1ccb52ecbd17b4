"""Keyed state with timers: the volume detector that ticks by itself, and the list of recent anomalies.

State lives in the state store of the query (RocksDB, checkpointed), so a micro-batch reads and writes only the keys that it
touches or whose timer is due. ``clock`` chooses what moves the timers: ``"event"`` is the watermark, with results that do not depend on when
the job runs, ``"processing"`` is the wall clock, so that a bucket is judged when its time is over even if every record has stopped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from sparklog import schemas
from sparklog.functions.clock import bucket_start, width_seconds
from sparklog.operators.anomaly import volume_events
from sparklog.session import ship_package

CLOCKS = {"event": "EventTime", "processing": "ProcessingTime"}
#: Due buckets from which a key's counters are read as a whole instead of one by one.
CATCH_UP = 64

_COUNTED = schemas.table(project_id="long", service_id="string", tick="long", n="long", seen_at="timestamp")
_JUDGED = schemas.table(project_id="long", service_id="string", tick="long", points="long", total="decimal(38,0)",
                        squares="decimal(38,0)", current_volume="long")


def _now_ms(timers, clock: str) -> int:
    return timers.getCurrentWatermarkInMs() if clock == "event" else timers.getCurrentProcessingTimeInMs()


# --- volume detector ------------------------------------------------------------------------------------

def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key and bucket of each Arrow batch, so that a hot service does not send its records to one task."""
    schema = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        seen = table.schema.field("seen_at").type
        schema = schema or pa.schema([("project_id", pa.int64()), ("service_id", pa.string()), ("tick", pa.int64()),
                                      ("n", pa.int64()), ("seen_at", seen)])
        summed = table.group_by(["project_id", "service_id", "tick"]).aggregate([([], "count_all"), ("seen_at", "max")])
        named = summed.select(["project_id", "service_id", "tick", "count_all", "seen_at_max"]).rename_columns(schema.names)
        yield from named.cast(schema).to_batches()


class VolumeProcessor(StatefulProcessor):
    """Per project and service: the counters of one look-back, their running sums, and a timer at the end of the next bucket.

    ``sums`` holds the last judged bucket and, of the look-back that ends with it, the number of present buckets, their total and
    sum of squares (as text: exact whatever their size). A late record corrects the sums while its bucket is looked back on.
    """

    def __init__(self, step: int, lookback: int, clock: str):
        self.step, self.lookback, self.clock = step, lookback, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "tick long", "n long")
        self.sums = handle.getValueState("sums", "judged long, points long, total string, squares string, timer long")

    def handleInputRows(self, key, rows, timerValues):
        fresh: dict[int, int] = {}
        for row in rows:
            fresh[row.tick] = fresh.get(row.tick, 0) + row.n
        judged, points, total, squares, timer = self._state()
        if judged is None:
            judged = min(fresh) - self.step
        elif timer is None:  # nothing to look back on or to judge: the buckets of the silence are not judged
            judged = max(judged, min(fresh) - self.step)
        for tick, n in sorted(fresh.items()):
            if tick < judged - self.lookback:
                continue
            old = self.counts.getValue((tick,))
            before = 0 if old is None else old[0]
            self.counts.updateValue((tick,), (before + n,))
            if tick <= judged:
                points += old is None
                total += n
                squares += (before + n) ** 2 - before**2
        self._keep(judged, points, total, squares, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        judged, points, total, squares, timer = self._state()
        if judged is None or expiredTimerInfo.getExpiryTimeInMs() != timer:
            return
        last = _now_ms(timerValues, self.clock) // 1000 // self.step * self.step - self.step
        whole = None
        if (last - judged) // self.step > CATCH_UP:
            whole = {k[0]: v[0] for k, v in self.counts.iterator()}

        def count(tick: int) -> int | None:
            if whole is not None:
                return whole.get(tick)
            found = self.counts.getValue((tick,))
            return None if found is None else found[0]

        while judged < last:
            judged += self.step
            here, gone = count(judged), count(judged - self.lookback - self.step)
            if here is not None:
                points, total, squares = points + 1, total + here, squares + here**2
            if gone is not None:
                points, total, squares = points - 1, total - gone, squares - gone**2
                self.counts.removeKey((judged - self.lookback - self.step,))
                if whole is not None:
                    del whole[judged - self.lookback - self.step]
            if points > 0:
                yield Row(project_id=key[0], service_id=key[1], tick=judged, points=points, total=Decimal(total), squares=Decimal(squares),
                          current_volume=here or 0)
                continue
            ahead = sorted(t for t in (whole or (k[0] for k in self.counts.keys())) if t > judged)
            if not ahead:
                break
            judged = max(judged, min(ahead[0] - self.step, last))
        self._keep(judged, points, total, squares, None)

    def _state(self):
        stored = self.sums.get()
        if stored is None:
            return None, 0, 0, 0, None
        judged, points, total, squares, timer = stored
        return judged, points, int(total), int(squares), None if timer < 0 else timer

    def _keep(self, judged: int, points: int, total: int, squares: int, timer: int | None) -> None:
        """Stores the sums; the timer goes to the end of the next bucket as long as there is something to look back on."""
        if timer is None and (points > 0 or next(iter(self.counts.keys()), None) is not None):
            timer = (judged + 2 * self.step) * 1000
            self.handle.registerTimer(timer)
        self.sums.update((judged, points, str(total), str(squares), -1 if timer is None else timer))


def judged_volumes(
    logs: DataFrame, width: str = "1 minute", lookback: str = "24 hours", delay: str = "0 seconds", clock: str = "processing",
) -> DataFrame:
    """A stream with one row per key and complete bucket that has something to look back on: its volume and the sums of its look-back.

    A bucket is judged once, when the clock passes its end. With the event clock, records that come more than ``delay`` after newer ones
    are dropped; with the processing clock a late record counts in the look-backs that still reach its bucket. Records without
    time are passed over, those without a project count for project 0, as in ``minute_counts``. A key that has been silent for a whole
    look-back holds no counters and no timer. The records of a key are counted in every task before they meet, so a hot key costs a row
    per Arrow batch and bucket.
    """
    ship_package(logs.sparkSession)
    keyed = logs.where(F.col("timestamp").isNotNull()).select(
        F.coalesce(F.col("project_id"), F.lit(0)).cast("bigint").alias("project_id"), "service_id",
        F.unix_seconds(bucket_start(F.col("timestamp"), width)).alias("tick"), F.col("timestamp").alias("seen_at"))
    partial = keyed.mapInArrow(_partial_counts, _COUNTED).withWatermark("seen_at", delay)
    processor = VolumeProcessor(width_seconds(width), width_seconds(lookback), clock)
    judged = partial.groupBy("project_id", "service_id").transformWithState(processor, _JUDGED, "Append", CLOCKS[clock])
    return judged.withColumn("timestamp", F.timestamp_seconds("tick")).drop("tick")


def volume_alarms(judged: DataFrame, min_points: int = 10, min_drop_mean: float = 5.0) -> DataFrame:
    """The anomalies among :func:`judged_volumes`, by the rules of the batch detector."""
    return volume_events(judged, min_points, min_drop_mean)


# --- recent anomalies -----------------------------------------------------------------------------------

class RecentProcessor(StatefulProcessor):
    """Per project: the times and ids of the listed anomalies, at most ``n``, and a timer for the oldest of them.

    What it gives out are the changes: an anomaly with ``listed`` true when it enters, its time and id with false when it leaves.
    Entries are (microseconds, id); the newest comes first, of equal times the smallest id.
    """

    def __init__(self, n: int, age: int, clock: str, columns: list[str]):
        self.n, self.age, self.clock, self.columns = n, age, clock, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "at long, event_id string")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues):
        listed, edge = self._listed(), self._edge(timerValues)
        known, best = set(listed), {}
        for row in rows:
            entry = (row.at, row.event_id)
            if row.at >= edge and entry not in known:
                best.setdefault(entry, row)
            if len(best) > 2 * self.n:  # bounded, whatever a project sends
                best = {e: best[e] for e in self._first(best)}
        yield from self._changes(key, listed, self._first([*listed, *best], edge), best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        listed = self._listed()
        yield from self._changes(key, listed, self._first(listed, self._edge(timerValues)), {})

    def _listed(self) -> list[tuple[int, str]]:
        return [tuple(e) for e in self.entries.get()] if self.entries.exists() else []

    def _edge(self, timers) -> int:
        return _now_ms(timers, self.clock) * 1000 - self.age

    def _first(self, entries, edge: int | None = None) -> list[tuple[int, str]]:
        young = (e for e in entries if edge is None or e[0] >= edge)
        return heapq.nsmallest(self.n, young, key=lambda e: (-e[0], e[1]))

    def _changes(self, key, listed: list[tuple], kept: list[tuple], rows: dict[tuple, Row]):
        stays, before = set(kept), set(listed)
        for at, event_id in listed:
            if (at, event_id) not in stays:
                left = {"project_id": key[0], "event_id": event_id, "at": at, "listed": False}
                yield Row(**{c: left.get(c) for c in self.columns})
        for entry in kept:
            if entry not in before:
                yield Row(**{c: True if c == "listed" else rows[entry][c] for c in self.columns})
        if kept:
            self.entries.put(kept)
        else:
            self.entries.clear()
        due = (kept[-1][0] + self.age) // 1000 + 1 if kept else None
        old = self.due.get()[0] if self.due.exists() else None
        if old is not None and old != due:
            self.handle.deleteTimer(old)
            self.due.clear()
        if due is not None and old != due:
            self.handle.registerTimer(due)
            self.due.update((due,))


def recent_changes(anomalies: DataFrame, n: int = 50, days: int = 7, delay: str = "0 seconds", clock: str = "processing") -> DataFrame:
    """A stream of the changes of every project's list of the last ``n`` anomalies that are not older than ``days``.

    Anomalies without a time or an id are not listed; one that is sent again is listed once. An anomaly that enters and leaves
    within one micro-batch is not told.
    """
    ship_package(anomalies.sparkSession)
    names = schemas.VOLUME_ANOMALY.fieldNames()
    rows = anomalies.select(*names, F.unix_micros("timestamp").alias("at")).where("at is not null and event_id is not null")
    plain = StructType([f for f in schemas.VOLUME_ANOMALY.fields if f.name != "timestamp"]).add("at", "long").add("listed", "boolean")
    processor = RecentProcessor(n, days * 86_400_000_000, clock, plain.fieldNames())
    changes = rows.withWatermark("timestamp", delay).groupBy("project_id").transformWithState(processor, plain, "Append", CLOCKS[clock])
    return changes.withColumn("timestamp", F.timestamp_micros("at")).select(*names, "listed")
