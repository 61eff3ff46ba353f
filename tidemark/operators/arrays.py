"""Profiles, runs and extremes of numeric arrays (raster rows) with built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_profile(rows: DataFrame, array: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean by place over all arrays: keys, x, mean."""
    return rows.select(*keys, F.posexplode(array).alias("x", "v")).groupBy(*keys, "x").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def row_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a))


def fraction_at_or_above(a: Column, limit: float) -> Column:
    return F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: x >= limit)) / F.size(a)).otherwise(0.0)


def fraction_at_or_below(a: Column, limit: float) -> Column:
    return F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: x <= limit)) / F.size(a)).otherwise(0.0)


def border_run(a: Column, limit: float) -> Column:
    """How many values from the start are at or below the limit."""
    inside = F.filter(F.transform(a, lambda x, i: F.when(x > limit, i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_min(inside), F.size(a))


def first_minimum(a: Column, margin: int = 0) -> Column:
    """0-based place of the least value, the first of several, `margin` away from both ends."""
    part = F.slice(a, F.lit(margin + 1), F.size(a) - 2 * margin)
    return F.when(F.size(part) > 0, F.array_position(part, F.array_min(part)) - 1 + margin)


def sliding_min(a: Column, radius: int) -> Column:
    """Least value within radius of each place."""
    return F.transform(a, lambda _, i: F.array_min(F.slice(a, F.greatest(i - radius, F.lit(0)) + 1, F.least(i + radius, F.size(a) - 1) - F.greatest(i - radius, F.lit(0)) + 1)))


def clip_counts(a: Column, low: float, high: float) -> Column:
    """struct<shadows, highlights>: values at or beyond each end."""
    return F.struct(F.size(F.filter(a, lambda x: x <= low)).alias("shadows"), F.size(F.filter(a, lambda x: x >= high)).alias("highlights"))


def compose_mask(components: Column) -> Column:
    """Coverage of components (struct<op, value>) in order: add takes the larger, subtract and intersect multiply."""

    def step(c: Column, x: Column) -> Column:
        return F.when(x["op"] == "add", F.greatest(c, x["value"])).when(x["op"] == "subtract", c * (1 - x["value"])).otherwise(c * x["value"])

    return F.aggregate(components, F.lit(0.0), step)


def arg_max_last(a: Column) -> Column:
    """0-based place of the largest value, the last of several."""
    return F.size(a) - F.array_position(F.reverse(a), F.array_max(a))


def is_border_line(line: Column, dark: float, white: float, tolerance: float) -> Column:
    """Whether more than `tolerance` of a line is white, or dark."""
    return (fraction_at_or_above(line, white) > tolerance) | (fraction_at_or_below(line, dark) > tolerance)


def rows_of(pixels: Column, width: Column, height: Column) -> Column:
    """array<array>: the raster's rows."""
    return F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.slice(pixels, y * width + 1, width))


def columns_of(pixels: Column, width: Column, height: Column) -> Column:
    """array<array>: the raster's columns."""
    return F.transform(F.sequence(F.lit(0), width - 1), lambda x: F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.element_at(pixels, (y * width + x + 1).cast("int"))))


def edge_bounds(lines: Column, inside, most: Column) -> Column:
    """struct<first, last>: lines without the runs at both ends that are not `inside`, `most` of each at most; one line is left."""
    n = F.size(lines)
    flags = F.transform(lines, inside)
    run = lambda a: F.coalesce(F.array_min(F.filter(F.transform(a, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())), F.size(a))
    first = F.least(run(flags), most, n - 1)
    last = F.greatest(n - F.least(run(F.reverse(flags)), most), first + 1)
    return F.struct(first.alias("first"), last.alias("last"))


def trim_dark_edges(pixels: Column, width: Column, height: Column, dark: float, tolerance: float, most: int, inset: int) -> Column:
    """struct<left, top, right, bottom> without dark edges of up to `most` lines a side, then moved in by inset."""
    inside = lambda line: fraction_at_or_below(line, dark) <= tolerance
    x, y = edge_bounds(columns_of(pixels, width, height), inside, F.lit(most)), edge_bounds(rows_of(pixels, width, height), inside, F.lit(most))
    low = lambda e: F.least(e["first"] + inset, e["last"])
    high = lambda e: F.greatest(e["last"] - inset, e["first"])
    return F.struct(low(x).alias("left"), low(y).alias("top"), high(x).alias("right"), high(y).alias("bottom"))


def weighted_sum(weights: Column, values: Column) -> Column:
    """Sum of array<array> values by place, each array times its weight; weights that are not above 0 count for nothing."""
    pairs = F.filter(F.zip_with(weights, values, lambda w, v: F.struct(w.alias("w"), v.alias("v"))), lambda p: p["w"] > 0)
    zero = F.transform(values[0], lambda _: F.lit(0.0))
    return F.aggregate(pairs, zero, lambda acc, p: F.zip_with(acc, p["v"], lambda a, x: a + p["w"] * x))


def bilinear(grid: Column, width: int, height: int, u: Column, v: Column) -> Column:
    """A row-by-row grid at a place in 0..1, between the four cells around it."""
    x, y = (F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), t * n - 0.5)) for t, n in ((u, width), (v, height)))
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(width - 1)), F.least(y0 + 1, F.lit(height - 1))
    fx, fy = x - x0, y - y0
    at = lambda cx, cy: F.element_at(grid, cy * width + cx + 1)
    return (at(x0, y0) * (1 - fx) + at(x1, y0) * fx) * (1 - fy) + (at(x0, y1) * (1 - fx) + at(x1, y1) * fx) * fy


def first_largest(a: Column) -> Column:
    """0-based place of the largest value, the first of several."""
    return F.array_position(a, F.array_max(a)) - 1


def patch_medians(pixels: DataFrame, keys: Sequence[str], channels: Sequence[str], most_spread: float = 0.10) -> DataFrame:
    """keys, each channel's median (the mean of the two in the middle), and problem: a channel whose quartiles lie too far apart.

    A patch is a small box of pixels, whose size the caller bounds.
    """
    lists = pixels.groupBy(*keys).agg(*(F.array_sort(F.collect_list(c)).alias(c) for c in channels))
    at = lambda c, i: F.element_at(F.col(c), i.cast("int") + 1)
    n = lambda c: F.size(c)
    median = lambda c: F.when(n(c) % 2 == 0, (at(c, n(c) / 2 - 1) + at(c, n(c) / 2)) / 2).otherwise(at(c, F.floor(n(c) / 2)))
    wide = lambda c: at(c, F.floor(n(c) * 0.75)) - at(c, F.floor(n(c) * 0.25)) > most_spread
    problem = F.coalesce(*(F.when(wide(c), c) for c in channels))
    return lists.select(*keys, *(median(c).alias(f"{c}_median") for c in channels), problem.alias("problem"))
