"""Rules over shots: checks, their worst result, what fails together, and deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DAY, elapsed_days, format_shift
from .stats import upper_median

#: How bad each status is.
SEVERITY = {"pass": 0, "pending": 1, "warn": 2, "fail": 3}
MONTH = 30


def worst(status: Column) -> Column:
    """Aggregate: the worst status of a group."""
    rank = F.coalesce(*(F.when(status == k, v) for k, v in SEVERITY.items()))
    return F.element_at(F.array(*(F.lit(k) for k in SEVERITY)), F.max(rank) + 1)


def check_date(capture: Column, now: Column, median: Column, spread: Column, max_age_days: int) -> Column:
    """struct<status, failure>: no date; too far from now (with its whole card or alone); far from its card's median; or fine.

    A card's clock is off if its median is out of range and all its captures (spread: seconds between first and last) lie within 30 days.
    """
    age = elapsed_days(capture, now)
    batch = (elapsed_days(median, now) > max_age_days) & (F.floor(spread / DAY) < MONTH)
    status = F.when(capture.isNull(), "fail").when(age > max_age_days, "fail").when(elapsed_days(capture, median) > MONTH, "warn").otherwise("pass")
    failure = F.when(capture.isNull(), "no_date").when(age > max_age_days, F.when(batch, "date_out_of_range_batch").otherwise("date_out_of_range")).when(elapsed_days(capture, median) > MONTH, "date_outlier")
    return F.struct(status.alias("status"), failure.alias("failure"))


def check_location(has_location: Column, card_has_location: Column) -> Column:
    bad = ~has_location & card_has_location
    return F.struct(F.when(bad, "warn").otherwise("pass").alias("status"), F.when(bad, "no_location").alias("failure"))


def check_resolution(width: Column, height: Column, megapixels: float) -> Column:
    unknown = width.isNull() | height.isNull() | (width <= 0) | (height <= 0)
    over = width.cast("bigint") * height.cast("bigint") > F.lit(int(megapixels * 1_000_000))
    limited = F.lit(megapixels > 0)
    status = F.when(~limited, "pass").when(unknown, "warn").when(over, "fail").otherwise("pass")
    return F.struct(status.alias("status"), F.when(limited & unknown, "dimensions_unknown").when(limited & over, "too_many_pixels").alias("failure"))


def check_size(size: Column, limit: int) -> Column:
    over = size > limit
    return F.struct(F.when(over, "fail").otherwise("pass").alias("status"), F.when(over, "too_large").alias("failure"))


def validate(shots: DataFrame, *, card: str, ident: str, now: int, max_age_days: int, max_bytes: int, megapixels: float) -> DataFrame:
    """A row per shot and rule: card, ident, rule, status, failure.

    shots has capture (seconds or null), bytes, width, height, has_location. What
    a rule needs of the whole card comes from a row per card.
    """
    medians = upper_median(shots, [card], "capture").select(F.col(card).alias("_card"), F.col("capture").alias("median"))
    cards = shots.groupBy(F.col(card).alias("_c")).agg(F.max("has_location").alias("any_location"), (F.max("capture") - F.min("capture")).alias("spread")).join(medians, F.col("_c").eqNullSafe(F.col("_card")), "left").drop("_card")
    rows = shots.join(cards, F.col(card).eqNullSafe(F.col("_c")))
    rules = {
        "date": check_date(F.col("capture"), F.lit(now), F.col("median"), F.col("spread"), max_age_days),
        "location": check_location(F.col("has_location"), F.col("any_location")),
        "resolution": check_resolution(F.col("width"), F.col("height"), megapixels),
        "size": check_size(F.col("bytes"), max_bytes),
    }
    checks = F.array(*(F.struct(F.lit(k).alias("rule"), v["status"].alias("status"), v["failure"].alias("failure")) for k, v in rules.items()))
    return rows.select(card, ident, F.inline(checks))


def worst_status(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return checks.groupBy(*keys).agg(worst(F.col("status")).alias("status"))


def by_failure(checks: DataFrame, ident: str) -> DataFrame:
    """failure, n, and the first and last of the shots that have it; the shots themselves are `with_failure`."""
    return checks.where("failure is not null").groupBy("failure").agg(F.count("*").alias("n"), F.min(ident).alias("first_id"), F.max(ident).alias("last_id"))


def with_failure(checks: DataFrame, ident: str) -> DataFrame:
    """failure and ident, a row per shot and failure, laid out by failure: a group is a range of rows, never one value."""
    return checks.where("failure is not null").select("failure", ident).distinct()


def clock_offset_medians(shots: DataFrame, card: str, now: int, max_age_days: int) -> DataFrame:
    """card, median and affected of the cards whose clock seems wrong: the median is out of range, yet all captures lie within 30 days."""
    spread = shots.groupBy(F.col(card).alias("_c")).agg((F.max("capture") - F.min("capture")).alias("spread"), F.count("capture").alias("affected"))
    rows = upper_median(shots, [card], "capture").select(card, F.col("capture").alias("median")).join(spread, F.col(card).eqNullSafe(F.col("_c")))
    wrong = (elapsed_days(F.col("median"), F.lit(now)) > max_age_days) & (F.floor(F.col("spread") / DAY) < MONTH)
    return rows.where(wrong).select(card, "median", "affected")


def clock_offset(shots: DataFrame, card: str, now: int, max_age_days: int) -> DataFrame:
    """Cards whose clock seems wrong: the median is out of range, yet all captures lie within 30 days. card, affected, shift."""
    return clock_offset_medians(shots, card, now, max_age_days).select(card, "affected", format_shift(F.lit(now) - F.col("median")).alias("shift"))


def disposition(manifest: DataFrame, published: DataFrame, staged: DataFrame, key: str, size: str = "bytes") -> DataFrame:
    """manifest with disposition: already_published, already_staged (same size), or send."""
    p = published.select(F.col(key).alias("_p")).distinct()
    s = staged.groupBy(F.col(key).alias("_s")).agg(F.max(size).alias("_size"))
    rows = manifest.join(p, F.col(key) == F.col("_p"), "left").join(s, F.col(key) == F.col("_s"), "left")
    what = F.when(F.col("_p").isNotNull(), "already_published").when(F.col("_size") == F.col(size), "already_staged").otherwise("send")
    return rows.withColumn("disposition", what).drop("_p", "_s", "_size")


def verify_arrivals(expected: DataFrame, arrived: DataFrame, name: str) -> DataFrame:
    """expected (name, bytes, sha256) with outcome: missing, short_file, hash_mismatch or verified."""
    a = arrived.select(F.col(name).alias("_name"), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    rows = expected.join(a, F.col(name) == F.col("_name"), "left")
    what = F.when(F.col("_name").isNull(), "missing").when(F.col("_bytes") != F.col("bytes"), "short_file").when(F.col("_sha") != F.col("sha256"), "hash_mismatch").otherwise("verified")
    return rows.withColumn("outcome", what).drop("_name", "_bytes", "_sha")


def skip_groups(skips: DataFrame, reason: str = "reason") -> DataFrame:
    return skips.groupBy(reason).agg(F.count("*").alias("n"))
