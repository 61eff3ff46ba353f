"""Order statistics, counts by local day, modes and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import local_day
from ..staging import sized, stage
from .sequence import with_neighbour


def kth_value(df: DataFrame, keys: Sequence[str], value: str, k: Column, *, bins: int = 4096, most: int = 1 << 20) -> DataFrame:
    """keys, n, <value>: the value at 0-based place k (an expression of n) of each group, in ascending order.

    Nulls do not count. No group is sorted whole: values fall into `bins` ranges
    between the group's extremes, and sums find the range that holds the place.
    That range is cut again, between its own extremes, until no group has more
    than `most` values in it, or only one value as often as it likes; what is
    left is put in order. A few values far out thus cost a round, not a sort.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(n) for c, n in zip(keys, names, strict=True)), F.col(value).alias("_v"))
    first = rows.groupBy(*names).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n"))
    wanted = stage(first.withColumn("_at", k.cast("long")).withColumn("_c", F.col("n")), "wanted")

    def inside(wanted: DataFrame) -> DataFrame:
        on = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        for c in names:
            on = on & F.col(c).eqNullSafe(F.col(f"w{c}"))
        renamed = wanted.select(*(F.col(c).alias(f"w{c}") for c in names), "_lo", "_hi", "n", "_at", "_c")
        return rows.join(sized(renamed), on).drop(*(f"w{c}" for c in names))

    while wanted.where((F.col("_c") > most) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi").cast("double") - F.col("_lo").cast("double")) / bins)
        bin_ = F.coalesce(F.least(F.floor((F.col("_v").cast("double") - F.col("_lo").cast("double")) / width), F.lit(bins - 1)), F.lit(0))
        per_bin = inside(wanted).groupBy(*names, "n", "_at", bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        per_bin = per_bin.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        hit = per_bin.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_c")))
        wanted = stage(hit.withColumn("_at", F.col("_at") - F.col("_before")).drop("_before", "_bin"), "wanted")
    counted = inside(wanted).groupBy(*names, "n", "_at", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*names).orderBy("_v"))
    out = counted.withColumn("_upto", upto).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_c")))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keys, names, strict=True)), "n", F.col("_v").alias(value))


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The middle value, the upper one of two; never a mean."""
    return kth_value(df, keys, value, F.floor(F.col("n") / 2))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, p: float) -> DataFrame:
    """The least value with at least max(1, ceil(n p)) values up to it."""
    return kth_value(df, keys, value, F.greatest(F.lit(1), F.ceil(F.col("n") * p)) - 1)


def day_coverage(df: DataFrame, at: str, offset_seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows by local day; days without rows are absent."""
    return df.groupBy(*keys, local_day(F.col(at), offset_seconds).alias("day")).agg(F.count("*").alias("n"))


def mode_of(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value, the least of several; nulls do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("a"), F.col(value).alias("b")))
    return counts.groupBy(*keys).agg(best.alias("_m")).select(*keys, f"_m.{value}", "_m.n")


def histogram_256(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts of whole values 0..255 by key, zeros included; others are clipped to the ends."""
    binned = df.groupBy(*keys, F.greatest(F.lit(0), F.least(F.lit(255), F.col(value))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    bins = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return bins.join(binned, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_percentile(hist: DataFrame, keys: Sequence[str], p: float) -> DataFrame:
    """First bin whose running count reaches max(1, ceil(n p)). hist has 256 rows a key."""
    whole = Window.partitionBy(*keys)
    up = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.withColumn("_acc", F.sum("n").over(up)).withColumn("_need", F.greatest(F.lit(1), F.ceil(F.sum("n").over(whole) * p)))
    return rows.where(F.col("_acc") >= F.col("_need")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def resolution_seconds(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Upper median of the gaps between consecutive instants, 60 at least."""
    rows = with_neighbour(df.where(F.col(at).isNotNull()).select(*keys, at), keys, [at], {"_last": at})
    gaps = rows.withColumn("gap", F.col(at) - F.col("_last"))
    return upper_median(gaps, keys, "gap").withColumn("gap", F.greatest(F.lit(60), F.col("gap")))


def extent(df: DataFrame, at: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def bounds(df: DataFrame, keys: Sequence[str] = (), lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(lat).alias("south"), F.min(lon).alias("west"), F.max(lat).alias("north"), F.max(lon).alias("east"))


def histogram_channels(pixels: DataFrame, keys: Sequence[str], channels: Sequence[str] = ("r", "g", "b"), low: int = 0, high: int = 255) -> DataFrame:
    """keys, channel (also `luma`), histogram (256 counts), shadows and highlights of 8-bit pixels, in one pass.

    shadows and highlights count the values at or beyond each end. Pixels are
    summed by value first, so a task sends at most 256 counts for each channel.
    Nulls count for nothing.
    """
    from ..functions.colour import luma_709

    named = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("int").alias("v")) for c in channels), F.struct(F.lit("luma").alias("channel"), luma_709(*(F.col(c) for c in channels)).cast("int").alias("v")))
    values = pixels.select(*keys, F.explode(named).alias("x")).select(*keys, "x.channel", "x.v").where("v between 0 and 255")
    counts = values.groupBy(*keys, "channel", "v").agg(F.count("*").alias("n"))
    at = F.map_from_entries(F.collect_list(F.struct("v", "n")))
    sums = counts.groupBy(*keys, "channel").agg(at.alias("m"), F.sum(F.when(F.col("v") <= low, F.col("n")).otherwise(0)).alias("shadows"), F.sum(F.when(F.col("v") >= high, F.col("n")).otherwise(0)).alias("highlights"))
    histogram = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long")))
    return sums.select(*keys, "channel", histogram.alias("histogram"), "shadows", "highlights")
