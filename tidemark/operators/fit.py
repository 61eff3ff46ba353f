"""Fits by sums: sliders found on histograms, and a colour matrix by least squares over charts of any number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from ..staging import stage, unstage

STEPS = 12


def bisect(low: Column, high: Column, below: Callable[[Column], Column], steps: int = STEPS) -> Column:
    """The middle of what is left of [low, high] after so many halvings; below(x) says that x is too small. One expression, no loop over rows."""

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        small = below(middle)
        return F.struct(F.when(small, middle).otherwise(s["low"]).alias("low"), F.when(small, s["high"]).otherwise(middle).alias("high"))

    zero = F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, halve, lambda s: (s["low"] + s["high"]) / 2)


def shown(bin_: Column, exposure: Column, whites: Column, blacks: Column) -> Column:
    """Display value (0 to 255) of a bin of linear light (0 to 255) under three sliders."""
    x = (bin_ + 0.5) / 256 * F.pow(F.lit(2.0), exposure)
    white, black = colour.white_black_weights(x)
    moved = x * F.pow(F.lit(2.0), (whites * white + blacks * black) / 100)
    return 255 * colour.linear_to_srgb(moved)


def percentile_bin(histogram: Column, fraction: float) -> Column:
    """The first bin up to which at least this fraction of all counts lies; null for a histogram of nothing."""
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda s, n: s + n)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("bin"))
    step = lambda s, n: F.struct((s["seen"] + n).alias("seen"), F.when(s["seen"] + n < F.greatest(F.lit(1.0), F.ceil(total * fraction)), s["bin"] + 1).otherwise(s["bin"]).alias("bin"))
    return F.when(total > 0, F.aggregate(histogram, start, step)["bin"])


def auto_tone(histograms: DataFrame, histogram: str = "histogram") -> DataFrame:
    """The columns of histograms with exposure, whites and blacks that bring median and ends of the display values to where they belong.

    A histogram has 256 counts of linear light. What the sliders do keeps the
    order of values, so a percentile after them is the percentile's bin taken
    through them, and pixels are not read again. Exposure (-2 to 2) brings a
    median outside 95 to 135 to the nearer of both, and goes no further than
    250 at the 99.5th percentile. Whites (-50 to 50) bring a 99.5th percentile
    below 235 up to it, or one of 254 and above down to 250. Blacks do the same
    for the 0.5th percentile: above 20 down to it, below 2 up to 5. A histogram
    of nothing gives nulls.
    """
    h = F.col(histogram)
    middle, top, foot = (percentile_bin(h, f) for f in (0.5, 0.995, 0.005))
    zero = F.lit(0.0)
    rows = histograms.withColumn("__m", middle).withColumn("__t", top).withColumn("__f", foot)
    now = shown(F.col("__m"), zero, zero, zero)
    target = F.greatest(F.lit(95.0), F.least(F.lit(135.0), now))
    wanted = F.when(now.between(95, 135), 0.0).otherwise(F.round(bisect(F.lit(-2.0), F.lit(2.0), lambda e: shown(F.col("__m"), e, zero, zero) < target), 2))
    rows = rows.withColumn("__e", F.when(F.col("__m").isNotNull(), wanted))
    held = F.round(bisect(F.lit(0.0), F.col("__e"), lambda e: shown(F.col("__t"), e, zero, zero) < 250), 2)
    over = (F.col("__e") > 0) & (shown(F.col("__t"), F.col("__e"), zero, zero) > 250)
    rows = rows.withColumn("exposure", F.when(over, F.least(F.col("__e"), held)).otherwise(F.col("__e")))
    e = F.col("exposure")
    high = shown(F.col("__t"), e, zero, zero)
    goal = F.when(high < 235, 235.0).when(high >= 254, 250.0)
    whites = F.when(goal.isNull(), 0.0).otherwise(F.round(bisect(F.lit(-50.0), F.lit(50.0), lambda w: shown(F.col("__t"), e, w, zero) < goal), 1))
    rows = rows.withColumn("whites", F.when(F.col("__t").isNotNull(), whites))
    w = F.col("whites")
    low = shown(F.col("__f"), e, w, zero)
    floor = F.when(low > 20, 20.0).when(low < 2, 5.0)
    blacks = F.when(floor.isNull(), 0.0).otherwise(F.round(bisect(F.lit(-50.0), F.lit(50.0), lambda b: shown(F.col("__f"), e, w, b) < floor), 1))
    return rows.withColumn("blacks", F.when(F.col("__f").isNotNull(), blacks)).drop("__m", "__t", "__f", "__e")


# --- least squares over charts ---------------------------------------------------------------------------------------------

OURS, TARGET = ("r", "g", "b"), ("target_r", "target_g", "target_b")
#: Least light that a model gives: below it the cube root is too steep.
LEAST = 1e-4
#: Weight of staying near the identity.
RIDGE = 4e-4
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def _model(m: Column, c: int) -> Column:
    """Channel c of a patch's colour under a matrix of nine numbers."""
    return sum((m[3 * c + j] * F.col(OURS[j]) for j in range(1, 3)), m[3 * c] * F.col(OURS[0]))


def _shares(c: int) -> list[Column]:
    """What a patch adds to channel c's normal equations: six products and three right-hand sides."""
    y = F.greatest(_model(F.col("m"), c), F.lit(LEAST))
    slope = F.lit(1 / 3) * F.pow(y, F.lit(-2 / 3))
    off = F.cbrt(F.greatest(F.col(TARGET[c]), F.lit(LEAST))) - F.cbrt(y)
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    x = [F.col(k) for k in OURS]
    return [w * slope * slope * x[i] * x[j] for i, j in _PAIRS] + [w * slope * off * x[i] for i in range(3)]


def _solved(m: Column, sums: Column, c: int) -> list[Column]:
    """Channel c's three numbers after one step: the normal equations with the ridge, solved by the inverse."""
    at = {p: sums[9 * c + k] for k, p in enumerate(_PAIRS)}
    a = [[at[min(i, j), max(i, j)] + (RIDGE if i == j else 0.0) for j in range(3)] for i in range(3)]
    right = [sums[9 * c + 6 + i] - RIDGE * (m[3 * c + i] - (1.0 if i == c else 0.0)) for i in range(3)]
    inverse = colour.invert_3x3(a)
    step = [sum((inverse[i][j] * right[j] for j in range(1, 3)), inverse[i][0] * right[0]) for i in range(3)]
    return [F.coalesce(m[3 * c + i] + step[i], m[3 * c + i]) for i in range(3)]


def _identity() -> Column:
    return F.array(*(F.lit(1.0 if i in (0, 4, 8) else 0.0) for i in range(9)))


def _sums(patches: DataFrame) -> DataFrame:
    """chart, m and the sums of all patches' shares: partial sums, whatever the size of a chart."""
    shares = patches.select("chart", "m", *(s.alias(f"s{9 * c + k}") for c in range(3) for k, s in enumerate(_shares(c))))
    return shares.groupBy("chart").agg(F.first("m").alias("m"), F.array(*(F.sum(f"s{k}") for k in range(27))).alias("sums"))


def fit_matrices(patches: DataFrame, iterations: int = 8) -> DataFrame:
    """chart, matrix (nine numbers), sums: the colour matrix of each chart, by Gauss-Newton on cube roots.

    patches has chart, r, g, b, target_r, target_g, target_b and weight (null:
    1), all in linear light. Each iteration is one grouped sum of the patches'
    shares in the normal equations, and one small solve for each chart: no chart
    is gathered. A chart whose equations have no solution keeps the identity.
    Patches with a null colour or target count for nothing.
    """
    known = patches.dropna(subset=["chart", *OURS, *TARGET])
    charts = stage(known.select("chart").distinct().select("chart", _identity().alias("m")), "charts")
    for _ in range(iterations):
        sums = _sums(known.join(charts, "chart"))
        solved = F.array(*(v for c in range(3) for v in _solved(F.col("m"), F.col("sums"), c)))
        after = stage(sums.select("chart", solved.alias("m")), "charts")
        unstage(charts)
        charts = after
    return _sums(known.join(charts, "chart")).select("chart", F.col("m").alias("matrix"), "sums")


def leave_one_out(patches: DataFrame, fitted: DataFrame, id_col: str = "patch") -> DataFrame:
    """chart, patch, error: how far the chart's matrix, fitted without the patch, misses it (distance of cube roots).

    The patch's share is taken out of the chart's sums, and one more step is
    solved from there: no fit is run again. The step is exact for the equations
    as they stand around the chart's matrix; a fit that is run again would go on
    from there: by 0.001 for most patches of the tests' charts, by up to 0.2 for
    one whose target is nearly black, where cube roots are steep.
    """
    met = patches.dropna(subset=["chart", *OURS, *TARGET]).join(fitted.select("chart", F.col("matrix").alias("m"), "sums"), "chart")
    own = F.array(*(s for c in range(3) for s in _shares(c)))
    without = met.withColumn("sums", F.zip_with("sums", own, lambda a, b: a - b))
    moved = without.withColumn("m", F.array(*(v for c in range(3) for v in _solved(F.col("m"), F.col("sums"), c))))
    miss = [F.cbrt(F.greatest(_model(F.col("m"), c), F.lit(LEAST))) - F.cbrt(F.greatest(F.col(TARGET[c]), F.lit(LEAST))) for c in range(3)]
    return moved.select("chart", id_col, F.sqrt(miss[0] * miss[0] + miss[1] * miss[1] + miss[2] * miss[2]).alias("error"))
