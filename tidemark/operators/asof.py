"""As-of matching of probes with fixes, and estimates of a clock's offset.

A key's fixes may be a third of all rows, so nothing is windowed over a whole
key. Time is cut into buckets; within a bucket (key, bucket) windows look back
and ahead; across buckets only one row per bucket, its first and last fix, is
carried on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import duration
from ..functions.geo import in_range
from ..staging import stage
from .sequence import with_neighbour


def neighbours(probes: DataFrame, fixes: DataFrame, keys: Sequence[str], *, at: str = "at", order: Sequence[str] = (), bucket_seconds: int = 86_400) -> DataFrame:
    """probes with prev and next: structs of the last fix at or before and the first at or after the probe.

    Both tables have the key columns and `at` in seconds. Fixes of one key and
    instant are ordered by `order`: prev is the last of them, next the first.
    Rows with a null instant have no neighbours.
    """
    values = [c for c in fixes.columns if c not in keys]
    fix = F.struct(*values)
    left = probes.select(*(F.col(c) for c in keys), F.col(at).alias("_at"), F.struct(*probes.columns).alias("_probe"), F.lit(None).cast(fixes.select(fix.alias("f")).schema["f"].dataType).alias("_fix"))
    right = fixes.where(F.col(at).isNotNull()).select(*(F.col(c) for c in keys), F.col(at).alias("_at"), F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), fix.alias("_fix"))
    rows = left.unionByName(right).withColumn("_bucket", F.floor(F.col("_at") / bucket_seconds))
    tie = F.struct(*(F.col(f"_fix.{c}") for c in order)) if order else F.lit(0)
    part = Window.partitionBy(*keys, "_bucket")
    # at one instant, looking back: fixes before the probe; looking ahead: the probe before fixes
    back = part.orderBy("_at", F.col("_fix").isNull(), tie).rowsBetween(Window.unboundedPreceding, 0)
    ahead = part.orderBy("_at", F.col("_fix").isNotNull(), tie).rowsBetween(0, Window.unboundedFollowing)
    near = rows.withColumn("_prev", F.last("_fix", ignorenulls=True).over(back)).withColumn("_next", F.first("_fix", ignorenulls=True).over(ahead)).where("_probe is not null")

    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by("_fix", F.when(F.col("_fix").isNotNull(), F.struct("_at", tie.alias("t")))).alias("_last"), F.min_by("_fix", F.when(F.col("_fix").isNotNull(), F.struct("_at", tie.alias("t")))).alias("_first"))
    span = Window.partitionBy(*keys).orderBy("_bucket")
    carried = ends.select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)),
        F.col("_bucket").alias("_kb"),
        F.last("_last", ignorenulls=True).over(span.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_prev"),
        F.first("_first", ignorenulls=True).over(span.rowsBetween(1, Window.unboundedFollowing)).alias("_carry_next"),
    )
    on = F.col("_bucket") == F.col("_kb")
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = near.join(carried, on, "left")
    known = F.col("_at").isNotNull()
    return out.select("_probe.*", F.when(known, F.coalesce("_prev", "_carry_prev")).alias("prev"), F.when(known, F.coalesce("_next", "_carry_next")).alias("next"))


def match(probes: DataFrame, fixes: DataFrame, keys: Sequence[str], *, at: str = "at", method: str = "carry_forward", tolerance: int = 0, order: Sequence[str] = (), bucket_seconds: int = 86_400) -> DataFrame:
    """probes with fix (struct or null), method, gap (seconds) and reason (text where nothing matched).

    A fix at the same instant always wins (`exact`). carry_forward takes the last
    fix before, and where there is none the first after, which it calls
    `nearest`; nearest takes the closer side, the earlier one of two as close.
    A tolerance above 0 refuses larger gaps; the limit itself is allowed.
    """
    rows = neighbours(probes, fixes, keys, at=at, order=order, bucket_seconds=bucket_seconds)
    before, after = F.col(at) - F.col(f"prev.{at}"), F.col(f"next.{at}") - F.col(at)
    exact = before == 0
    if method == "carry_forward":
        use_prev = before.isNotNull()
    elif method == "nearest":
        use_prev = before.isNotNull() & (after.isNull() | (before <= after))
    else:
        raise ValueError(f"no such method: {method}")
    label = F.when(F.coalesce(exact, F.lit(False)), "exact").when(use_prev, "carried_forward" if method == "carry_forward" else "nearest").when(after.isNotNull(), "nearest")
    gap = F.when(use_prev, before).otherwise(after)
    good = F.coalesce(gap <= tolerance, F.lit(False)) if tolerance > 0 else gap.isNotNull()
    reason = F.when(F.col(at).isNull(), "no instant").when(gap.isNull(), "no fix").when(~good, F.concat(F.lit("nearest fix is "), duration(gap), F.lit(" away")))
    return rows.select(
        *probes.columns,
        F.when(good, F.when(use_prev, F.col("prev")).otherwise(F.col("next"))).alias("fix"),
        F.when(good, label).otherwise("none").alias("method"),
        gap.alias("gap"),
        reason.alias("reason"),
    )


def bracket_window(df: DataFrame, lo: int, hi: int, *, at: str = "at", margin: int = 0) -> DataFrame:
    """Rows from lo - margin to hi + margin, and the one row before and the one after them."""
    a, b = lo - margin, hi + margin
    inside = df.where(F.col(at).between(a, b))
    row = F.struct(*df.columns)
    one = lambda side, pick: df.where(side).agg(pick(row, F.struct(at, row)).alias("r")).where("r is not null").select("r.*")
    return inside.unionByName(one(F.col(at) < a, F.max_by)).unionByName(one(F.col(at) > b, F.min_by))


#: Offsets in minutes that clocks are set to, from west to east.
UTC_OFFSETS = (-720, -660, -600, -570, -540, -480, -420, -360, -300, -240, -210, -180, -120, -60, 0, 60, 120, 180, 210, 240, 270, 300, 330, 345, 360, 390, 420, 480, 525, 540, 570, 600, 630, 660, 720, 765, 780, 840)


def score_offsets(captures: DataFrame, fixes: DataFrame, keys: Sequence[str], *, at: str = "at", offsets: Sequence[int] = UTC_OFFSETS) -> DataFrame:
    """keys, offset_minutes, n, median_gap: the upper median of the captures' gaps to the nearest fix under each offset.

    captures hold local clock seconds. Each capture becomes one probe per
    offset, a fixed number, and meets the fixes in one as-of pass.
    """
    from .stats import upper_median

    probes = captures.withColumn("offset_minutes", F.explode(F.array(*(F.lit(o) for o in offsets)))).withColumn(at, F.col(at) - F.col("offset_minutes") * 60)
    near = stage(match(probes, fixes, keys, at=at, method="nearest").where("gap is not null").select(*keys, "offset_minutes", "gap"), "gaps")  # read twice below
    return upper_median(near, [*keys, "offset_minutes"], "gap").withColumnRenamed("gap", "median_gap")


def estimate_offset(captures: DataFrame, fixes: DataFrame, keys: Sequence[str], *, at: str = "at", offsets: Sequence[int] = UTC_OFFSETS, least_captures: int = 3, confident_seconds: int = 1800) -> DataFrame:
    """keys, offset_minutes, median_gap, plausible (offsets within the track's resolution of the best), confident."""
    from .stats import resolution_seconds

    scored = stage(score_offsets(captures, fixes, keys, at=at, offsets=offsets).where(F.col("n") >= least_captures), "scores")
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("median_gap", "offset_minutes"), F.struct("median_gap", F.abs("offset_minutes"), "offset_minutes")).alias("best"))
    step = resolution_seconds(fixes, keys, at).select(*keys, F.col("gap").alias("step"))
    near = scored.join(best, list(keys)).join(step, list(keys), "left").where(F.col("median_gap") <= F.col("best.median_gap") + F.coalesce("step", F.lit(60)))
    out = near.groupBy(*keys, "best").agg(F.array_sort(F.collect_list("offset_minutes")).alias("plausible"))
    return out.select(*keys, "best.offset_minutes", "best.median_gap", "plausible", ((F.size("plausible") == 1) & (F.col("best.median_gap") <= confident_seconds)).alias("confident"))


def overlapping(intervals: DataFrame, keys: Sequence[str], start: str, end: str, ident: str) -> DataFrame:
    """Intervals that end before they start, or that reach past the start of the next one."""
    rows = with_neighbour(intervals, keys, [start, end, ident], {"_next": start}, after=True)
    problem = F.when(F.col(end) < F.col(start), "inverted").when(F.col("_next") < F.col(end), "overlaps next")
    return rows.withColumn("problem", problem).where("problem is not null").drop("_next")


def placed_points(stops: DataFrame, keys: Sequence[str], start: str, end: str, ident: str, lat: str = "lat", lon: str = "lon") -> tuple[DataFrame, DataFrame]:
    """(points, refused): two points for a stop that lasts, one for an instant, with their `at`; stops that cannot be written, with a problem."""
    off = stops.where(~in_range(F.col(lat), F.col(lon))).withColumn("problem", F.lit("no place on Earth"))
    on_earth = stops.where(in_range(F.col(lat), F.col(lon)))
    refused = off.unionByName(overlapping(on_earth, keys, start, end, ident))
    good = on_earth.join(refused.select(F.col(ident).alias("_refused")), F.col(ident) == F.col("_refused"), "left_anti")
    return good.withColumn("at", F.explode(F.array_distinct(F.array(start, end)))), refused


