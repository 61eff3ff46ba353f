"""Pixels as rows: what strokes cover, and means around each pixel, by tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..staging import stage, unstage

TILE = 16
#: Strokes that are folded at once; more of them fold over levels.
FOLD = 64


def _segments(strokes: DataFrame, frames: DataFrame) -> DataFrame:
    """A row for each two points that follow each other, in pixels; a stroke of one point is a dab."""
    points = F.col("points")
    ends = F.when(F.size(points) == 1, F.array(F.struct(points[0].alias("p"), points[0].alias("q")))).otherwise(
        F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    )
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c)))
    known = strokes.where(F.size(points) > 0).join(frames, "frame")
    r = F.greatest(clip("radius", 0.0005, 0.5) * F.greatest("width", "height"), F.lit(0.5))
    sized = known.select("frame", "width", "height", "stroke", "erase", r.alias("r"), (r * (1 - clip("feather", 0.0, 1.0))).alias("inner"), clip("flow", 0.0, 1.0).alias("flow"), F.explode(ends).alias("e"))
    at = lambda end, axis, size: (F.col(f"e.{end}.{axis}") * F.col(size)).alias(f"{axis}{0 if end == 'p' else 1}")
    return sized.select("*", at("p", "x", "width"), at("p", "y", "height"), at("q", "x", "width"), at("q", "y", "height")).drop("e")


def _footprint(qx: Column, qy: Column) -> Column:
    """How much a segment covers of a pixel with its middle at (qx, qy): full near the line, falling smoothly to 0 at the radius."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((qx - F.col("x0")) * dx + (qy - F.col("y0")) * dy) / len2))).otherwise(0.0)
    ex, ey = qx - (F.col("x0") + t * dx), qy - (F.col("y0") + t * dy)
    d = F.sqrt(ex * ex + ey * ey)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - F.col("inner")) / F.greatest(F.col("r") - F.col("inner"), F.lit(1e-6))))
    fall = F.when(d <= F.col("inner"), 1.0).otherwise(1 - s * s * (3 - 2 * s))
    return F.when(d < F.col("r"), fall * F.col("flow")).otherwise(0.0)


def stroke_coverage(strokes: DataFrame, frames: DataFrame) -> DataFrame:
    """frame, x, y, alpha, beta of every pixel that strokes change: coverage c becomes alpha * c + beta.

    strokes has frame, stroke (their order in a frame), points (array of x, y in
    0..1), radius, feather, flow and erase; frames has frame, width, height. A
    stroke covers a pixel as much as the nearest of its segments does. It is
    added as c + s - c * s, or erased as c - c * s.

    Each segment goes to the tiles near it, and to the pixels within the radius
    there: no pixel meets a segment of another part of the picture. The largest
    share of each stroke is kept by a partial maximum, so a hot pixel costs one
    row for each task and stroke. What strokes do in turn is a chain of linear
    maps, which combine in any grouping: FOLD at a time, over as many levels as
    there are strokes for. Strokes without points or of unknown frames cover
    nothing.
    """
    parts = _segments(strokes, frames)
    lo = lambda a, b: F.floor(F.greatest(F.least(a, b) - F.col("r"), F.lit(0.0)))
    hi = lambda a, b, size: F.least(F.ceil(F.greatest(a, b) + F.col("r")), F.col(size)) - 1
    boxed = parts.select("*", lo("x0", "x1").alias("xa"), hi("x0", "x1", "width").alias("xb"), lo("y0", "y1").alias("ya"), hi("y0", "y1", "height").alias("yb")).where("xa <= xb and ya <= yb")
    tiles = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / TILE), F.floor(F.col(b) / TILE)))
    dealt = boxed.withColumn("ty", tiles("ya", "yb")).withColumn("tx", tiles("xa", "xb"))
    reach = F.col("r") + TILE * 0.70711 + 0.5
    near = dealt.where(_distance((F.col("tx") + 0.5) * TILE, (F.col("ty") + 0.5) * TILE) < reach)
    within = lambda t, a, b: F.explode(F.sequence(F.greatest(F.col(t) * TILE, F.col(a)), F.least(F.col(t) * TILE + TILE - 1, F.col(b))))
    pixels = near.withColumn("y", within("ty", "ya", "yb")).withColumn("x", within("tx", "xa", "xb"))
    shares = pixels.withColumn("s", _footprint(F.col("x") + 0.5, F.col("y") + 0.5)).where("s > 0")
    each = shares.groupBy("frame", "x", "y", "stroke").agg(F.max("s").alias("s"), F.first("erase").alias("erase"))
    maps = each.select("frame", "x", "y", F.col("stroke").cast("long").alias("n"), (1 - F.col("s")).alias("alpha"), F.when(F.col("erase"), 0.0).otherwise(F.col("s")).alias("beta"))
    return _folded(maps)


def _distance(qx: Column, qy: Column) -> Column:
    """From a place to the segment."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((qx - F.col("x0")) * dx + (qy - F.col("y0")) * dy) / len2))).otherwise(0.0)
    return F.hypot(qx - (F.col("x0") + t * dx), qy - (F.col("y0") + t * dy))


def _folded(maps: DataFrame) -> DataFrame:
    """Linear maps (frame, x, y, n, alpha, beta) of a pixel after one another in order of n, over levels of FOLD."""
    maps = stage(maps, "strokes")
    most = maps.agg(F.max("n")).first()[0]
    while most is not None:
        inner = F.struct(F.lit(1.0).alias("alpha"), F.lit(0.0).alias("beta"))
        step = lambda m, k: F.struct((m["alpha"] * k["alpha"]).alias("alpha"), (m["beta"] * k["alpha"] + k["beta"]).alias("beta"))
        lists = maps.groupBy("frame", "x", "y", F.floor(F.col("n") / FOLD).alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", "alpha", "beta"))).alias("k"))
        after = lists.select("frame", "x", "y", "n", F.aggregate("k", inner, step).alias("m")).select("frame", "x", "y", "n", "m.alpha", "m.beta")
        most //= FOLD
        if most == 0:
            return after.drop("n")
        now = stage(after, "strokes")
        unstage(maps)
        maps = now
    return maps.drop("n")


def around_means(pixels: DataFrame, channels: list[str], radius: int = 2, tile: int = 64) -> DataFrame:
    """frame, x, y and each channel's mean over the square of `radius` around the pixel, clipped at the picture's edge.

    A tile gets its own pixels and a halo of the pixels within `radius` of it,
    so a pixel near an edge goes to at most four tiles, and no task holds more than
    (tile + 2 * radius)^2 pixels. Pixels that are not there count for nothing.
    """
    ship(pixels.sparkSession)
    touch = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile)))
    dealt = pixels.select("frame", "x", "y", *(F.col(c).cast("double").alias(c) for c in channels)).withColumn("tx", F.explode(touch("x"))).withColumn("ty", F.explode(touch("y")))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, tx, ty = key
        size = tile + 2 * radius
        x, y = (part["x"] - tx * tile + radius).to_numpy(), (part["y"] - ty * tile + radius).to_numpy()
        own = (x >= radius) & (x < tile + radius) & (y >= radius) & (y < tile + radius)

        def sums(values: np.ndarray) -> np.ndarray:
            grid = np.zeros((size + 1, size + 1))
            grid[y + 1, x + 1] = values
            grid = grid.cumsum(0).cumsum(1)
            a, b = np.maximum(y - radius, 0), np.minimum(y + radius + 1, size)
            c, d = np.maximum(x - radius, 0), np.minimum(x + radius + 1, size)
            return grid[b, d] - grid[a, d] - grid[b, c] + grid[a, c]

        n = sums(np.ones(len(part)))
        out = {c: (sums(part[c].to_numpy()) / n)[own] for c in channels}
        return part.loc[own, ["frame", "x", "y"]].assign(**out)

    kinds = ", ".join([f"{c} {pixels.schema[c].dataType.simpleString()}" for c in ("frame", "x", "y")] + [f"{c} double" for c in channels])
    return dealt.groupBy("frame", "tx", "ty").applyInPandas(run, kinds)


def colours_at(pixels: DataFrame, frames: DataFrame, clicks: DataFrame, channels: list[str]) -> DataFrame:
    """The columns of clicks (frame, u, v in 0..1) with each channel's mean over 5 x 5 pixels, and problem: a click outside, or of no frame."""
    at = lambda c, size: F.round(F.col(c) * (F.col(size) - 1)).cast("long")
    inside = F.col("u").between(0, 1) & F.col("v").between(0, 1)
    known = clicks.join(frames, "frame", "left")
    placed = known.withColumn("__x", F.when(inside, at("u", "width"))).withColumn("__y", F.when(inside, at("v", "height")))
    means = around_means(pixels, channels).select(F.col("frame").alias("__f"), F.col("x").cast("long").alias("__px"), F.col("y").cast("long").alias("__py"), *channels)
    met = placed.join(means, (F.col("frame") == F.col("__f")) & (F.col("__x") == F.col("__px")) & (F.col("__y") == F.col("__py")), "left")
    problem = F.when(~F.coalesce(inside, F.lit(False)), "outside the picture").when(F.col("__f").isNull(), "no such picture")
    return met.select(*clicks.columns, *channels, problem.alias("problem"))
