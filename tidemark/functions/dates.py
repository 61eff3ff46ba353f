"""Dates, shifts and offsets as column expressions. Instants are epoch seconds; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def seconds(ts: Column) -> Column:
    """Whole epoch seconds of a timestamp with or without zone, rounded down."""
    return F.unix_seconds(ts.cast("timestamp"))


def unquoted(x: Column) -> Column:
    """Without white space and quotation marks around."""
    return F.trim(F.regexp_replace(F.trim(x), '^"+|"+$', ""))


def normalise_datetime(x: Column) -> Column:
    """A camera's date: colons or hyphens, space or T, zone and fraction dropped, a bare date is midnight, zeros are null."""
    flat = F.regexp_replace(unquoted(x), r"^(\d{4})[:-](\d{2})[:-](\d{2})", "$1-$2-$3")
    flat = F.regexp_replace(flat, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}).*$", "$1 $2")
    whole = F.when(flat.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(flat, F.lit(" 00:00:00"))).when(flat.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), flat)
    return F.when(~whole.startswith("0000"), F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ss")))


def best_date(tags: dict[str, Column]) -> Column:
    """struct<value, tag> of the first tag, in order, whose date can be read."""
    read = {k: normalise_datetime(v) for k, v in tags.items()}
    return F.coalesce(*(F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(k).alias("tag"))) for k, v in read.items()))


def utc_offset_minutes(x: Column) -> Column:
    """Minutes of `+HH:MM`: 0 to 14 hours and any minutes, sign and padding optional, quotes allowed; null otherwise."""
    pattern = r"^([+-]?)\s*\+?(\d{1,9})\s*:\s*\+?(\d{1,9})$"
    bare = unquoted(x)
    part = lambda k: F.when(bare.rlike(pattern), F.regexp_extract(bare, pattern, k))
    hours, minutes = part(2).cast("int"), part(3).cast("int")
    sign = F.when(part(1) == "-", -1).otherwise(1)
    return F.when((hours <= 14) & (minutes < 60), sign * (hours * 60 + minutes))


def shift_parts(x: Column) -> Column:
    """Signed numbers of a shift `+Y:M:D h:m:s`; only the sign in front counts."""
    pattern = r"^\s*([+-]?)(\d+):(\d+):(\d+) (\d+):(\d+):(\d+)\s*$"
    sign = F.when(F.regexp_extract(x, pattern, 1) == "-", -1).otherwise(1)
    names = ("years", "months", "days", "hours", "minutes", "seconds")
    return F.when(x.rlike(pattern), F.struct(*((sign * F.regexp_extract(x, pattern, k + 2).cast("int")).alias(n) for k, n in enumerate(names))))


def shift_magnitude(parts: Column) -> Column:
    """The shift as it is written, without its sign."""
    return F.format_string("%d:%d:%d %d:%d:%d", *(F.abs(parts[n]) for n in ("years", "months", "days", "hours", "minutes", "seconds")))


def apply_shift(ts: Column, parts: Column) -> Column:
    """Months first (held to the month's end), then days, then the clock."""
    return ts + F.make_ym_interval(parts["years"], parts["months"]) + F.make_dt_interval(parts["days"], parts["hours"], parts["minutes"], parts["seconds"].cast("decimal(18,6)"))


def format_shift(secs: Column) -> Column:
    a = F.abs(secs)
    day = F.floor(a / DAY)
    return F.format_string("%s0:0:%d %d:%d:%d", F.when(secs < 0, "-").otherwise("+"), day, F.floor((a % DAY) / 3600), F.floor((a % 3600) / 60), a % 60)


def day_start(at: Column, offset: Column | int) -> Column:
    """Start of the local day, in UTC seconds; rounded down before the epoch too."""
    local = at + offset
    return local - F.pmod(local, F.lit(DAY)) - offset


def local_day(at: Column, offset: Column | int) -> Column:
    """Number of the local day since the epoch."""
    local = at + offset
    return ((local - F.pmod(local, F.lit(DAY))) / DAY).cast("long")


def local_date(at: Column, offset: Column | int) -> Column:
    return F.date_format(F.timestamp_seconds(at + offset), "yyyy-MM-dd")


def rfc3339(at: Column) -> Column:
    return F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def instant(x: Column) -> Column:
    """Epoch seconds of an RFC 3339 text; without a zone it is UTC, fractions are dropped."""
    return F.floor(F.unix_micros(F.try_to_timestamp(F.replace(F.trim(x), F.lit(" "), F.lit("T")))) / 1_000_000)


def duration(secs: Column) -> Column:
    """A span as it is said: seconds below two minutes, minutes below two hours, hours below two days; a second unit unless it is 0."""
    a = F.abs(secs)
    two = lambda big, unit, small, rest: F.concat(F.format_string(f"%d {unit}", big), F.when(small > 0, F.format_string(f" %d {rest}", small)).otherwise(""))
    return (
        F.when(a < 120, F.format_string("%d s", a))
        .when(a < 7200, F.format_string("%d min", F.floor(a / 60)))
        .when(a < 2 * DAY, two(F.floor(a / 3600), "h", F.floor((a % 3600) / 60), "min"))
        .otherwise(two(F.floor(a / DAY), "days", F.floor((a % DAY) / 3600), "h"))
    )


def elapsed_days(a: Column, b: Column) -> Column:
    """Whole days between two instants, truncated."""
    return F.floor(F.abs(a - b) / DAY)
