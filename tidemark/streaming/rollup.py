"""Fixes as they come in: one copy of each, closed days, daily tracks that late fixes amend, and quiet keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_start
from ..operators.ledger import insert_or_ignore
from ..operators.shots import set_hash
from ..staging import stage, unstage

GRACE = "2 hours"
#: Files that a day's rows are spread over at most, by device: a day is no single task's, however many devices report.
SPREAD = 16


def once_each(stream: DataFrame, keys: list[str], ts: str = "ts", grace: str = GRACE) -> DataFrame:
    """The first row of each key within the grace period."""
    return stream.withWatermark(ts, grace).dropDuplicatesWithinWatermark(keys)


def closed_days(stream: DataFrame, ts: str = "ts", grace: str = GRACE, offset_seconds: int = 0) -> DataFrame:
    """day_start and n of local days that ended a grace period before the newest row; for append mode."""
    shift = f"{-offset_seconds % 86_400} seconds"
    days = stream.withWatermark(ts, grace).groupBy(F.window(ts, "1 day", startTime=shift))
    return days.agg(F.count("*").alias("n")).select(F.col("window.start").alias("day_start"), "n")


def merge_fixes(held: DataFrame, batch: DataFrame) -> DataFrame:
    """held and those fixes of a batch whose device and instant it has not; the first to come stays."""
    return insert_or_ignore(held, batch, ["device", "at"], [F.col("received_at"), F.col("lat"), F.col("lon")])


def daily_tracks(fixes: DataFrame, offset_seconds: int = 0) -> DataFrame:
    """device, day, n, first_at, last_at and a hash of the day's fixes: equal fixes give an equal track, late ones another.

    The hash sums hashes of rows, so no task holds a whole day.
    """
    line = F.concat_ws(":", F.col("at").cast("string"), F.format_string("%.7f", F.col("lat")), F.format_string("%.7f", F.col("lon")))
    day = day_start(F.col("at"), offset_seconds)
    return fixes.groupBy("device", day.alias("day")).agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), set_hash(line).alias("track_id"))


class Days:
    """Fixes and tracks in folders by local day; a batch rewrites the days that it touches and no others. The driver gets the list of those days."""

    def __init__(self, spark: SparkSession, root: str, offset_seconds: int = 0):
        self.spark, self.root, self.offset = spark, root.rstrip("/"), offset_seconds

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def _held(self, fresh: DataFrame, days: list[int]) -> DataFrame:
        try:
            return self.read("fixes").where(F.col("day").isin(days)).select(fresh.columns)
        except AnalysisException:  # no batch has come yet
            return fresh.limit(0)

    def merge(self, batch: DataFrame) -> None:
        fresh = batch.withColumn("day", day_start(F.col("at"), self.offset))
        days = [r["day"] for r in fresh.select("day").distinct().collect()]
        fixes = stage(merge_fixes(self._held(fresh, days), fresh), "fixes")
        for name, rows in (("fixes", fixes), ("tracks", daily_tracks(fixes, self.offset))):
            rows.repartition(F.col("day"), F.pmod(F.hash("device"), F.lit(SPREAD))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.root}/{name}")
        unstage(fixes)


def roll_up(store: Days):
    """A foreachBatch function that merges each batch into store.

    Fixes are never dropped for being late: their day gets an amended track.
    A batch that is tried again changes nothing, since its fixes are there.
    """
    return lambda batch, batch_id: store.merge(batch)  # noqa: ARG005


def quiet_keys(stream: DataFrame, key: str, ts: str = "ts", quiet: str = "10 minutes") -> DataFrame:
    """key, first and last time and n of bursts that a quiet period has ended; a new row within it restarts the wait."""
    return stream.withWatermark(ts, "0 seconds").groupBy(F.session_window(ts, quiet), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("quiet_at"), "n")
