"""Colour transfer functions, spaces and weights as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The OKLab matrices (linear sRGB to cone response, cone response to Lab, and back).
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
LAB_TO_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def times(matrix: tuple, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(x * r[0] + y * r[1] + z * r[2] for r in matrix)  # type: ignore[return-value]


def srgb_to_linear(x: Column) -> Column:
    c = clamp(x)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    c = clamp(x)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return times(LMS_TO_LAB, *(F.cbrt(v) for v in times(TO_LMS, r, g, b)))


def from_oklab(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    return times(FROM_LMS, *(v * v * v for v in times(LAB_TO_LMS, l, a, b)))


def rotate_hue(l: Column, a: Column, b: Column, degrees: Column | float) -> tuple[Column, Column, Column]:  # noqa: E741
    t = F.radians(degrees if isinstance(degrees, Column) else F.lit(degrees))
    return l, a * F.cos(t) - b * F.sin(t), a * F.sin(t) + b * F.cos(t)


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = clamp((x - lo) / (hi - lo))
    return t * t * (3 - 2 * t)


def tone_weights(x: Column, pivot: float = 0.18) -> tuple[Column, Column]:
    """Weights of highlights and shadows around middle grey, where both are 0."""
    return smoothstep(pivot, 0.65, x), 1 - smoothstep(0.05, pivot, x)


def white_black_weights(x: Column, pivot: float = 0.18) -> tuple[Column, Column]:
    """Weights of whites and blacks: the same over wider ramps."""
    return smoothstep(pivot, 1.0, x), 1 - smoothstep(0.02, pivot, x)


def base_tone(x: Column) -> Column:
    """A straight line up to 0.6, then a shoulder that reaches 1 with slope 0."""
    c = clamp(x)
    return F.when(c <= 0.6, 1.25 * c).otherwise(1 - 1.5625 * (1 - c) * (1 - c))


def range_weights(luma: Column, balance: Column, blending: Column) -> tuple[Column, Column, Column]:
    """Weights of shadows, midtones and highlights, which add up to 1.

    balance (-100 to 100) moves both crossovers, blending (0 to 100) widens them.
    """
    y = clamp(luma)
    shift = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), balance / 100)) * 0.2
    half = (0.1 + clamp(blending / 100) * 0.3) / 2
    rise = lambda centre: (1 - F.cos(math.pi * clamp((y - (centre - half)) / (2 * half)))) / 2
    low, high = 1 - rise(0.33 + shift), rise(0.67 + shift)
    shadows, highlights = low * (1 - high), high * (1 - low)
    return shadows, F.greatest(F.lit(0.0), 1 - shadows - highlights), highlights


def filmic(x: Column) -> Column:
    """A rational filmic curve, held to 0..1."""
    return clamp((x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14))


def luma_709(r: Column, g: Column, b: Column) -> Column:
    """Integer luma of 8-bit channels, rounded."""
    return F.floor((2126 * r + 7152 * g + 722 * b + 5000) / 10000)


def prophoto_encode(x: Column) -> Column:
    c = clamp(x)
    return F.when(c < 1 / 512, 16 * c).otherwise(F.pow(c, F.lit(1 / 1.8)))


def lookup_lerp(table: Column, x: Column) -> Column:
    """Value of a table spread evenly over 0..1, interpolated between its entries."""
    last = F.size(table) - 1
    at = clamp(x) * last
    low = F.least(F.floor(at).cast("int"), last)
    high = F.least(low + 1, last)
    a, b = F.element_at(table, low + 1), F.element_at(table, high + 1)
    return a + (b - a) * (at - low)


def noise(seed: Column | int, x: Column, y: Column) -> Column:
    """Hash noise in -1..1, the same for the same seed and place."""
    h = F.xxhash64(seed if isinstance(seed, Column) else F.lit(seed), x, y)
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 52) - 1


#: D50 white point and the constants of CIE Lab.
D50 = (0.96422, 1.0, 0.82521)
LAB_EPS, LAB_KAPPA = 216 / 24389, 24389 / 27


def xyz_to_lab(x: Column, y: Column, z: Column, white: tuple = D50) -> tuple[Column, Column, Column]:
    def f(v: Column, n: float) -> Column:
        t = v / n
        return F.when(t > LAB_EPS, F.cbrt(t)).otherwise((LAB_KAPPA * t + 16) / 116)

    fx, fy, fz = f(x, white[0]), f(y, white[1]), f(z, white[2])
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def delta_e_2000(l1: Column, a1: Column, b1: Column, l2: Column, a2: Column, b2: Column) -> Column:
    """CIEDE2000 colour difference, as published, with weights of 1."""
    power7 = 25.0**7
    c_mean = (F.hypot(a1, b1) + F.hypot(a2, b2)) / 2
    g = 0.5 * (1 - F.sqrt(F.pow(c_mean, 7) / (F.pow(c_mean, 7) + power7)))
    p1, p2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = F.hypot(p1, b1), F.hypot(p2, b2)
    hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    h1, h2 = hue(p1, b1), hue(p2, b2)
    grey = c1 * c2 == 0
    gap = h2 - h1
    dh = F.when(grey, 0.0).when(F.abs(gap) <= 180, gap).when(gap > 180, gap - 360).otherwise(gap + 360)
    dl, dc, dhh = l2 - l1, c2 - c1, 2 * F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2))
    lm, cm, total = (l1 + l2) / 2, (c1 + c2) / 2, h1 + h2
    hm = F.when(grey, total).when(F.abs(h1 - h2) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    cos = lambda d: F.cos(F.radians(d))
    t = 1 - 0.17 * cos(hm - 30) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + 6) - 0.20 * cos(4 * hm - 63)
    sl = 1 + 0.015 * F.pow(lm - 50, 2) / F.sqrt(20 + F.pow(lm - 50, 2))
    sc, sh = 1 + 0.045 * cm, 1 + 0.015 * cm * t
    turn = 60 * F.exp(-F.pow((hm - 275) / 25, 2))
    rt = -F.sin(F.radians(turn)) * 2 * F.sqrt(F.pow(cm, 7) / (F.pow(cm, 7) + power7))
    return F.sqrt(F.greatest(F.lit(0.0), F.pow(dl / sl, 2) + F.pow(dc / sc, 2) + F.pow(dhh / sh, 2) + rt * (dc / sc) * (dhh / sh)))


def band_weights(hue: Column, centres: tuple = (0, 30, 60, 120, 180, 240, 280, 320)) -> Column:
    """array<double>: raised-cosine weights of hue bands around a circle; between two centres they add up to 1."""
    out = []
    n = len(centres)
    for k, c in enumerate(centres):
        left, right = (c - centres[k - 1]) % 360, (centres[(k + 1) % n] - c) % 360
        ahead = F.pmod(hue - c, F.lit(360.0))
        behind = F.pmod(c - hue, F.lit(360.0))
        up = F.when(ahead < right, 0.5 + 0.5 * F.cos(F.lit(math.pi) * ahead / right)).when(behind < left, 0.5 + 0.5 * F.cos(F.lit(math.pi) * behind / left))
        out.append(F.coalesce(up, F.lit(0.0)))
    return F.array(*out)


def chroma_fade(chroma: Column) -> Column:
    return smoothstep(0.005, 0.025, chroma)


def radial_gain(x: Column, y: Column, amount: Column | float, inner: float = 0.5, outer: float = 1.0) -> Column:
    """Gain of a vignette at a place measured from the centre, corners at 1."""
    return 1 + (amount if isinstance(amount, Column) else F.lit(amount)) * smoothstep(inner, outer, F.hypot(x, y))


def invert_3x3(m: list[list[Column]]) -> Column:
    """array<array<double>>: the inverse; null if the determinant is below 1e-12."""
    minor = lambda r, c: m[r[0]][c[0]] * m[r[1]][c[1]] - m[r[0]][c[1]] * m[r[1]][c[0]]
    others = lambda k: [i for i in range(3) if i != k]
    det = sum(((-1) ** k * m[0][k] * minor((1, 2), others(k)) for k in range(3)), F.lit(0.0))
    rows = [F.array(*((-1) ** (i + j) * minor(others(j), others(i)) / det for j in range(3))) for i in range(3)]
    return F.when((F.abs(det) >= 1e-12) & ~F.isnan(det), F.array(*rows))


def colour_weight(hue: Column, chroma: Column, light: Column, at: tuple[float, float, float], span: float) -> Column:
    """How much a colour belongs to a picked one: full within half the widths, then falling to 0; greys fade out."""
    r = max(0.0, min(100.0, span))
    turn = F.abs(hue - at[0])
    gaps = (F.when(turn > 180, 360 - turn).otherwise(turn), F.abs(chroma - at[1]), F.abs(light - at[2]))
    widths = (8 + 0.52 * r, 0.04 + 0.002 * r, 0.12 + 0.004 * r)
    out = chroma_fade(chroma)
    for gap, width in zip(gaps, widths, strict=True):
        out = out * (1 - smoothstep(0.5, 1.0, gap / width))
    return out


def white_balance(r: Column, g: Column, b: Column) -> Column:
    """struct<temperature, tint, clamped, problem> that makes a linear colour grey; clipped, dark or empty channels give a problem."""
    luma = 0.2126 * r + 0.7152 * g + 0.0722 * b
    problem = F.when(F.greatest(r, g, b) >= 0.98, "clipped highlight").when(luma < 0.005, "deep shadow").when(F.least(r, g, b) <= 1e-6, "near-zero channel")
    ok = problem.isNull()
    temperature, tint = (F.when(ok, 100 * F.log2(x)) for x in (b / r, g * g / (r * b)))
    held = lambda x: F.greatest(F.lit(-100.0), F.least(F.lit(100.0), x))
    return F.struct(F.when(ok, held(temperature)).alias("temperature"), F.when(ok, held(tint)).alias("tint"), F.when(ok, (F.abs(temperature) > 100) | (F.abs(tint) > 100)).alias("clamped"), problem.alias("problem"))


def exposure_gain(ours: Column, target: Column) -> Column:
    """Aggregate: the middle ratio target / ours of the grey patches, a mean of two if there are four; 1 without any."""
    ratios = F.array_sort(F.collect_list(F.when(ours > 1e-6, target / ours)))
    n = F.size(ratios)
    middle = F.element_at(ratios, F.floor(n / 2).cast("int") + 1)
    return F.when(n == 0, 1.0).when(n == 4, (ratios[1] + ratios[2]) / 2).otherwise(middle)
