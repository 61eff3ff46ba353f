"""Keyed state with timers: keys that have gone quiet, and days that are due.

Unlike windows, which only close when later rows move the watermark, these can
run on processing time: a timer fires although no row of any key comes any more.
On event time the same processors follow the watermark, so that a drained stream
gives one result. State is kept by key in the RocksDB store, restarts go on from
the checkpoint.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import day_start
from ..session import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT, PROCESSING = "EventTime", "ProcessingTime"
#: Rows of state as bytes: a call to the store then costs the same for one row or many.
_BURST, _FIX, _TRACKS = struct.Struct("<4q"), struct.Struct("<2q2d"), struct.Struct("<2q")


def _packed(form: struct.Struct, rows: Iterable[tuple]) -> tuple[bytes]:
    return (b"".join(form.pack(*r) for r in rows),)


def _unpacked(form: struct.Struct, held: tuple | None) -> list[tuple]:
    return list(form.iter_unpack(held[0])) if held else []


def _prepare(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; a session that names another one of its own keeps it."""
    ship(spark)
    if "HDFSBackedStateStoreProvider" in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, _ROCKS)


def _clock(by_arrival: bool, timer_values) -> int:
    """What timers are held against in this batch: its processing time, or the watermark."""
    return timer_values.getCurrentProcessingTimeInMs() if by_arrival else timer_values.getCurrentWatermarkInMs()


def _due_at(handle: StatefulProcessorHandle, wanted: int) -> None:
    """Leaves the wanted timer alone of the current key."""
    held = set(handle.listTimers())
    for t in held - {wanted}:
        handle.deleteTimer(t)
    if wanted not in held:
        handle.registerTimer(wanted)


class QuietKeys(StatefulProcessor):
    """Bursts of a key: rows less than `quiet_ms` apart belong together, and a timer ends a burst that long after its last row.

    A value state holds the open bursts (first, last, n, seen): on event time
    several can be open at once, since rows come out of order, and a row between
    two of them joins both. On processing time `seen` is when the last row came,
    which is what the timer counts from. A key has one timer, for the burst that
    is over first; when it fires, all bursts that are over by then are given in
    one pass over the state, so a batch costs what is open once, not once for
    each burst.
    """

    def __init__(self, quiet_ms: int, by_arrival: bool):
        self.quiet, self.by_arrival = quiet_ms, by_arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "bursts binary")

    def _due(self, burst: list[int] | tuple[int, ...]) -> int:
        return math.ceil(burst[3] / 1000) + self.quiet

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        held = [list(x) for x in _unpacked(_BURST, self.open.get())]
        bursts = sorted(held + [[r["__at"], r["__at"], 1, now if self.by_arrival else r["__at"]] for r in rows])
        merged: list[list[int]] = []
        for b in bursts:
            near = merged and (self.by_arrival or b[0] - merged[-1][1] < self.quiet * 1000)
            if near:
                m = merged[-1]
                m[1], m[2], m[3] = max(m[1], b[1]), m[2] + b[2], max(m[3], b[3])
            else:
                merged.append(b)
        if merged:
            self.open.update(_packed(_BURST, merged))
            first = min(map(self._due, merged))
            if held:
                _due_at(self.handle, first)
            else:  # without open bursts there is no timer
                self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        clock = _clock(self.by_arrival, timerValues)
        over, still = [], []
        for b in _unpacked(_BURST, self.open.get()):
            (over if self._due(b) <= clock else still).append(b)
        if still:
            self.open.update(_packed(_BURST, still))
            _due_at(self.handle, min(map(self._due, still)))
        else:
            self.open.clear()
        for first, last, n, _ in over:
            yield Row(key=key[0], first_us=first, last_us=last, n=n)

    def close(self) -> None:
        pass


def quiet_keys(stream: DataFrame, key: str, *, ts: str = "ts", quiet_seconds: int = 600, grace: str = "0 seconds", time: str = EVENT) -> DataFrame:
    """key, first_ts, last_ts and n of each burst, once the key has been quiet; in append mode.

    On event time quiet_seconds count from a burst's newest `ts` to the
    watermark, and rows behind the watermark are dropped; on processing time they
    count from the last row's arrival, and whatever comes before starts the wait
    again. Rows without a key or time are left out.
    """
    _prepare(stream.sparkSession)
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    if time == EVENT:
        rows = rows.withWatermark(ts, grace)
    kind = rows.schema[key].dataType.simpleString()
    shaped = rows.select(F.col(key).alias("key"), F.col(ts), F.unix_micros(ts).alias("__at"))
    out = shaped.groupBy("key").transformWithState(QuietKeys(quiet_seconds * 1000, time == PROCESSING), f"key {kind}, first_us long, last_us long, n long", "Append", time)
    return out.select(F.col("key").alias(key), F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "n")


class DueDays(StatefulProcessor):
    """Fixes of one device and week, each local day written up as a track when it is due.

    Fixes are appended to a list state, a batch's as one value, and are only read when the
    timer fires, which is set for the first of the open days that is due: all
    days that are due by then are written up in one pass, and what is left is
    the day that has begun since. So a batch costs what it brings, and calls
    to the state are made for a device's week, not for each of its days. A value
    state counts the tracks of each day: a fix that comes after the first gives
    an amended one, with the new fixes alone.
    """

    def __init__(self, grace_ms: int, by_arrival: bool):
        self.grace, self.by_arrival = grace_ms, by_arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fixes = handle.getListState("fixes", "fixes binary")
        self.written = handle.getValueState("written", "tracks binary")

    def _due(self, day: int) -> int:
        return (day + 86_400) * 1000 + self.grace

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first: dict[tuple, tuple] = {}  # of one instant what was received first, unknown times last
        for r in rows:
            at, came = (r["day"], r["at"]), (r["received_at"] is None, r["received_at"] or 0)
            if at not in first or came < first[at][0]:
                first[at] = (came, r["lat"], r["lon"])
        self.fixes.appendValue(_packed(_FIX, ((*at, lat, lon) for at, (_, lat, lon) in first.items())))
        due = self._due(min(day for day, _ in first))
        if self.by_arrival:  # a day that is over already is due at once
            due = max(due, timerValues.getCurrentProcessingTimeInMs())
        _due_at(self.handle, min([due, *self.handle.listTimers()]))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        clock = _clock(self.by_arrival, timerValues)
        over: dict[int, dict[int, tuple]] = {}
        still = []
        for held in self.fixes.get():
            for day, at, lat, lon in _FIX.iter_unpack(held[0]):
                if self._due(day) <= clock:
                    over.setdefault(day, {}).setdefault(at, (lat, lon))
                else:
                    still.append((day, at, lat, lon))
        if still:
            self.fixes.put([_packed(_FIX, still)])
            _due_at(self.handle, min(self._due(f[0]) for f in still))
        else:
            self.fixes.clear()
        if over:
            tracks = dict(_unpacked(_TRACKS, self.written.get()))
            tracks |= {day: tracks.get(day, 0) + 1 for day in over}
            self.written.update(_packed(_TRACKS, sorted(tracks.items())))
        for day, first in sorted(over.items()):
            instants = sorted(first)
            lines = "\n".join(f"{at}:{first[at][0]:.7f}:{first[at][1]:.7f}" for at in instants)
            yield Row(device=key[0], day=day, track=tracks[day], n=len(instants), first_at=instants[0], last_at=instants[-1], track_id=hashlib.sha256(lines.encode()).hexdigest())

    def close(self) -> None:
        pass


def due_days(fixes: DataFrame, *, ts: str = "ts", grace_seconds: int = 7200, lateness: str = "0 seconds", offset_seconds: int = 0, time: str = EVENT) -> DataFrame:
    """device, day, track (1 for the first of a day), n, first_at, last_at and track_id of each day that is due: over for grace_seconds.

    fixes has device, at, lat, lon, received_at and the timestamp `ts` of the
    fix. Of several fixes at one instant the first received stays; equal fixes
    give an equal track_id. A key's state is what is open of one device's week, at most
    one fix for each of its seconds when it is read. Rows without a device, time or
    position are left out. On processing time a late fix gives an amended track;
    on event time fixes behind the watermark are dropped.
    """
    _prepare(fixes.sparkSession)
    rows = fixes.where("device is not null and at is not null and lat is not null and lon is not null")
    if time == EVENT:
        rows = rows.withWatermark(ts, lateness)
    shaped = rows.select("device", day_start(F.col("at"), offset_seconds).alias("day"), "at", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("received_at").cast("long").alias("received_at"), ts)
    shaped = shaped.withColumn("week", F.col("day") - F.pmod("day", F.lit(7 * 86_400)))
    kind = rows.schema["device"].dataType.simpleString()
    schema = f"device {kind}, day long, track int, n long, first_at long, last_at long, track_id string"
    return shaped.groupBy("device", "week").transformWithState(DueDays(grace_seconds * 1000, time == PROCESSING), schema, "Append", time)
