"""State with timers: on event time against plain Python, on processing time without any later row, and over a restart."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import timers

TOUCH = "k string, s long"
FIX = "device string, at long, lat double, lon double, received_at long"


def touches(spark, folder, rows):
    spark.createDataFrame(rows, TOUCH).select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(folder))


def drain(df, tmp_path, name):
    df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start(str(tmp_path / name)).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name)).collect()


def bursts(rows, quiet, now):
    out = []
    for k in {k for k, _ in rows}:
        open_ = []
        for s in sorted(s for x, s in rows if x == k):
            if open_ and s - open_[-1][-1] < quiet:
                open_[-1].append(s)
            else:
                open_.append([s])
        out += [(k, b[0], b[-1], len(b)) for b in open_ if b[-1] + quiet <= now]
    return sorted(out)


def test_bursts_on_event_time_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abcde"), rng.randrange(4000)) for _ in range(120)] + [("f", 100), ("f", 700), ("f", 1299)]
    touches(spark, tmp_path / "in", rows[:70])
    stream = timers.quiet_keys(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")), "k", quiet_seconds=600, grace="4000 seconds")
    drain(stream, tmp_path, "out")
    touches(spark, tmp_path / "in", [*rows[70:], ("z", 9_000)])  # another run of the query, from its checkpoint
    got = drain(stream, tmp_path, "out")
    assert sorted((r.k, int(r.first_ts.timestamp()), int(r.last_ts.timestamp()), r.n) for r in got) == bursts(rows, 600, 5_000)


def wait_for(found, seconds=60):
    until = time.time() + seconds
    while time.time() < until and not found():
        time.sleep(0.2)
    return found()


def test_quiet_key_fires_without_any_later_row(spark, tmp_path):
    touches(spark, tmp_path / "in", [("a", 10), ("a", 500_000)])
    stream = timers.quiet_keys(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")), "k", quiet_seconds=6, time=timers.PROCESSING)
    running = stream.writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        time.sleep(4)
        touches(spark, tmp_path / "in", [("a", 20)])  # starts the wait again
        began = time.time()
        rows = wait_for(lambda: spark.table("quiet").collect())
        assert [(r.k, r.n) for r in rows] == [("a", 3)] and time.time() - began > 4
    finally:
        running.stop()


def expected_days(rows, now):
    out = {}
    for device, at, lat, lon, received in sorted(rows, key=lambda r: r[4]):
        out.setdefault((device, at - at % 86_400), {}).setdefault(at, (lat, lon))
    text = lambda fixes: "\n".join(f"{t}:{fixes[t][0]:.7f}:{fixes[t][1]:.7f}" for t in sorted(fixes))
    return sorted((d, day, 1, len(f), min(f), max(f), hashlib.sha256(text(f).encode()).hexdigest()) for (d, day), f in out.items() if day + 86_400 + 7200 <= now)


def fixes(spark, folder, rows):
    spark.createDataFrame(rows, FIX).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(str(folder))


def test_days_close_two_hours_after_their_end(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["p", "q"]), rng.randrange(3 * 86_400), rng.random() * 90, rng.random() * 90, i) for i in range(200)]
    rows += [("p", rows[0][1], 1.0, 1.0, 999), ("q", 3 * 86_400 + 7200, 5.0, 5.0, 1000)]
    fixes(spark, tmp_path / "in", rows)
    stream = timers.due_days(spark.readStream.schema(f"{FIX}, ts timestamp").parquet(str(tmp_path / "in")))
    got = drain(stream, tmp_path, "days")
    assert sorted(tuple(r) for r in got) == expected_days(rows, 3 * 86_400 + 7200)


def test_late_fix_amends_a_day_on_processing_time(spark, tmp_path):
    fixes(spark, tmp_path / "in", [("p", 10, 1.0, 1.0, 1), ("p", 20, 1.0, 1.0, 2), ("p", 86_400, 2.0, 2.0, 3)])
    stream = timers.due_days(spark.readStream.schema(f"{FIX}, ts timestamp").parquet(str(tmp_path / "in")), time=timers.PROCESSING)

    def run(expect):
        running = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start(str(tmp_path / "out"))
        try:
            read = lambda: spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
            return wait_for(lambda: rows if len(rows := read()) >= expect else None)
        finally:
            running.stop()

    assert sorted((r.day, r.track, r.n) for r in run(2)) == [(0, 1, 2), (86_400, 1, 1)]
    fixes(spark, tmp_path / "in", [("p", 30, 3.0, 3.0, 4)])
    assert sorted((r.day, r.track, r.n) for r in run(3)) == [(0, 1, 2), (0, 2, 1), (86_400, 1, 1)]


@pytest.mark.parametrize("time_mode", [timers.EVENT, timers.PROCESSING])
def test_rows_without_key_or_time(spark, tmp_path, time_mode):
    spark.createDataFrame([(None, 5), ("a", None)], TOUCH).select("k", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = timers.quiet_keys(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")), "k", time=time_mode)
    if time_mode == timers.EVENT:
        assert drain(stream, tmp_path, "none") == []
    else:
        assert stream.isStreaming


class Held:
    """A state that counts what it is asked."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def called(self, out=None):
        self.calls += 1
        return out

    def getValueState(self, *_):  # noqa: N802
        return type("Value", (), {"get": lambda _: self.called(self.rows[0] if self.rows else None), "exists": lambda _: self.called(bool(self.rows)), "update": lambda _, x: self.called(self.rows.__setitem__(slice(None), [x])), "clear": lambda _: self.called(self.rows.clear())})()

    def getListState(self, *_):  # noqa: N802
        rows: list = []
        return type("List", (), {"get": lambda _: self.called(iter(list(rows))), "exists": lambda _: self.called(bool(rows)), "put": lambda _, x: self.called(rows.__setitem__(slice(None), x)), "appendValue": lambda _, x: self.called(rows.append(x)), "appendList": lambda _, x: self.called(rows.extend(x)), "clear": lambda _: self.called(rows.clear())})()

    def listTimers(self):  # noqa: N802
        return self.called(iter(sorted(self.timers)))

    def registerTimer(self, t):  # noqa: N802
        self.called(self.timers.add(t))

    def deleteTimer(self, t):  # noqa: N802
        self.called(self.timers.discard(t))


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getCurrentProcessingTimeInMs = lambda: ms


class At:
    def __init__(self, ms):
        self.getExpiryTimeInMs = lambda: ms


def fired(processor, held, key, now):
    out = []
    while due := sorted(t for t in held.timers if t <= now):
        out += list(processor.handleExpiredTimer(key, Now(now), At(due[0])))
        held.timers.discard(due[0])
    return out


def test_calls_to_the_state_do_not_grow_with_bursts(spark):
    calls = []
    for n in (20, 200):
        held, bursts_of = Held(), timers.QuietKeys(1000, False)
        bursts_of.init(held)
        bursts_of.handleInputRows(("k",), iter([{"__at": i * 5_000_000} for i in range(n)]), Now(0))
        assert len(fired(bursts_of, held, ("k",), (n - 1) * 5_000)) == n - 1 and len(held.timers) == 1
        assert [r.n for r in fired(bursts_of, held, ("k",), n * 5_000)] == [1] and not held.timers
        calls.append(held.calls)
    assert calls[0] == calls[1]


def test_a_devices_week_is_one_key(spark, tmp_path):
    """Seven days are written up in one pass; the day that is not over yet stays, with its own timer."""
    day = 86_400
    held, days = Held(), timers.DueDays(7_200_000, False)
    days.init(held)
    rows = [{"day": d * day, "at": d * day + s, "lat": 1.0, "lon": 2.0, "received_at": 9 - s} for d in range(7) for s in (1, 2, 1)]
    days.handleInputRows(("p", 0), iter(rows), Now(0))
    before = held.calls
    assert [(r.day, r.track, r.n) for r in fired(days, held, ("p", 0), 6 * day * 1000 + 7_200_000)] == [(d * day, 1, 2) for d in range(6)]
    assert held.timers == {7 * day * 1000 + 7_200_000} and held.calls - before < 12
