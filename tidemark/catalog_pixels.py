"""Registered queries over pixels, sliders and colour charts, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import EMB, ORACLES, PIX, RGB, colours, query, rasters, table
from .functions import colour
from .operators import arrays, coverage, fit, stats
from .sources import tables

W, H, RADIUS = 20, 16, 0.04
_R = RADIUS * W
_SPOT = "struct_pack(x := (event_id * 37 % 101) / 100.0::DOUBLE, y := (event_id * 61 % 97) / 96.0::DOUBLE)"
_SHARE = f"CASE WHEN d <= {_R} * 0.5 THEN 1.0::DOUBLE ELSE 1 - pow(greatest(0, least(1, (d - {_R} * 0.5) / ({_R} * 0.5))), 2) * (3 - 2 * greatest(0, least(1, (d - {_R} * 0.5) / ({_R} * 0.5)))) END * 0.6"


@query(f"""WITH p AS (SELECT user_id AS frame, event_id // 500 AS stroke, event_id, {_SPOT} AS p FROM events WHERE user_id IS NOT NULL),
s AS (SELECT frame, stroke, p.x * {W} AS x0, p.y * {H} AS y0, lead(p.x) OVER w * {W} AS x1, lead(p.y) OVER w * {H} AS y1, count(*) OVER (PARTITION BY frame, stroke) AS n FROM p WINDOW w AS (PARTITION BY frame, stroke ORDER BY event_id)),
g AS (SELECT frame, stroke, x0, y0, coalesce(x1, x0) AS x1, coalesce(y1, y0) AS y1 FROM s WHERE x1 IS NOT NULL OR n = 1),
c AS (SELECT *, x + 0.5::DOUBLE AS qx, y + 0.5::DOUBLE AS qy FROM g, range({W}) a(x), range({H}) b(y)),
t AS (SELECT *, CASE WHEN x1 = x0 AND y1 = y0 THEN 0::DOUBLE ELSE greatest(0, least(1, ((qx - x0) * (x1 - x0) + (qy - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) END AS t FROM c),
d AS (SELECT frame, stroke, x, y, sqrt(pow(qx - (x0 + t * (x1 - x0)), 2) + pow(qy - (y0 + t * (y1 - y0)), 2)) AS d FROM t),
m AS (SELECT frame, stroke, x, y, max({_SHARE}) AS s FROM d WHERE d < {_R} GROUP BY ALL HAVING max({_SHARE}) > 0),
o AS (SELECT frame, x, y, product(1 - s) AS alpha, list(struct_pack(s := s, e := stroke % 4 = 3) ORDER BY stroke) AS k FROM m GROUP BY ALL)
SELECT frame, x, y, round(alpha, 6) AS alpha, round(list_reduce(list_concat([0::DOUBLE], list_transform(k, lambda v: CASE WHEN v.e THEN -v.s ELSE v.s END)), lambda b, s: b * (1 - abs(s)) + greatest(s, 0)), 6) AS beta FROM o""")
def stroke_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as strokes on a small picture."""
    spot = F.struct(((F.col("event_id") * 37 % 101) / 100.0).alias("x"), ((F.col("event_id") * 61 % 97) / 96.0).alias("y"))
    e = table(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("frame"), F.expr("event_id div 500").alias("stroke"), "event_id", spot.alias("p"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "p"))), lambda v: v["p"])
    strokes = e.groupBy("frame", "stroke").agg(points.alias("points")).withColumns({"radius": F.lit(RADIUS), "feather": F.lit(0.5), "flow": F.lit(0.6), "erase": F.col("stroke") % 4 == 3})
    frames = e.select("frame").distinct().withColumns({"width": F.lit(W), "height": F.lit(H)})
    got = coverage.stroke_coverage(strokes, frames)
    return got.select("frame", "x", "y", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


@query(f"""WITH {PIX}, u AS (SELECT vec_id AS y, unnest(p) AS v, unnest(range(len(p))) AS x FROM px), o AS (SELECT unnest(range(-2, 3)) AS k),
n AS (SELECT u.x + a.k AS x, u.y + b.k AS y, v FROM u, o a, o b) SELECT n.x, n.y, round(avg(n.v), 6) AS v FROM n JOIN u ON u.x = n.x AND u.y = n.y GROUP BY ALL""")
def around_means(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings as one picture, a row each: means over 5 x 5 pixels."""
    pixels = rasters(spark, d).select(F.lit(0).alias("frame"), F.col("vec_id").alias("y"), F.posexplode("p").alias("x", "v"))
    got = coverage.around_means(pixels.select("frame", F.col("x").cast("long").alias("x"), "y", "v"), ["v"])
    return got.select("x", "y", F.round("v", 6).alias("v"))


def _smooth(lo: float, hi: float, x: str) -> str:
    t = f"greatest(0, least(1, ({x} - {lo}) / ({hi} - {lo})))"
    return f"({t} * {t} * (3 - 2 * {t}))"


_MACROS = f"""WITH RECURSIVE {PIX}, u AS (SELECT vec_id % 50 AS image, unnest(p) AS b FROM px), h AS (SELECT image, list_sort(list(b)) AS s FROM u GROUP BY image),
q AS (SELECT image, s[CAST(greatest(1, ceil(len(s) * 0.5)) AS BIGINT)] AS m, s[CAST(greatest(1, ceil(len(s) * 0.995)) AS BIGINT)] AS t, s[CAST(greatest(1, ceil(len(s) * 0.005)) AS BIGINT)] AS f FROM h)"""


def _shown(b: str, e: str, w: str, k: str) -> str:
    x = f"(({b} + 0.5::DOUBLE) / 256 * pow(2.0::DOUBLE, {e}))"
    y = f"greatest(0, least(1, {x} * pow(2.0::DOUBLE, ({w} * {_smooth(0.18, 1.0, x)} + {k} * (1 - {_smooth(0.02, 0.18, x)})) / 100)))"
    return f"(255 * CASE WHEN {y} <= 0.0031308 THEN {y} * 12.92 ELSE 1.055 * pow({y}, 1 / 2.4::DOUBLE) - 0.055 END)"


def _search(name: str, source: str, lo: str, hi: str, small: str) -> str:
    """A recursive table `name` (image, step, lo, hi) of halvings; small is a condition on {mid}."""
    mid = "((lo + hi) / 2)"
    return f"""{name}_ AS (SELECT {source}.*, 0 AS step, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi FROM {source} UNION ALL
SELECT * REPLACE (step + 1 AS step, CASE WHEN {small.format(mid=mid)} THEN {mid} ELSE lo END AS lo, CASE WHEN {small.format(mid=mid)} THEN hi ELSE {mid} END AS hi) FROM {name}_ WHERE step < 12),
{name} AS (SELECT * EXCLUDE (step, lo, hi), (lo + hi) / 2 AS {name}_found FROM {name}_ WHERE step = 12)"""


_Z = _shown("m", "0", "0", "0")
_TOP = _shown("t", "e", "0", "0")
_LOW = _shown("f", "e", "w", "0")


@query(f"""{_MACROS},
{_search("a", "q", "-2", "2", f"{_shown('m', '{mid}', '0', '0')} < greatest(95, least(135, {_Z}))")},
a2 AS (SELECT image, m, t, f, CASE WHEN {_Z} BETWEEN 95 AND 135 THEN 0 ELSE round(a_found, 2) END AS e0 FROM a),
{_search("b", "a2", "0", "e0", f"{_shown('t', '{mid}', '0', '0')} < 250")},
b2 AS (SELECT image, m, t, f, CASE WHEN e0 > 0 AND {_shown('t', 'e0', '0', '0')} > 250 THEN least(e0, round(b_found, 2)) ELSE e0 END AS e FROM b),
{_search("c", "b2", "-50", "50", f"{_shown('t', 'e', '{mid}', '0')} < CASE WHEN {_TOP} < 235 THEN 235 ELSE 250 END")},
c2 AS (SELECT image, m, t, f, e, CASE WHEN {_TOP} < 235 OR {_TOP} >= 254 THEN round(c_found, 1) ELSE 0 END AS w FROM c),
{_search("k", "c2", "-50", "50", f"{_shown('f', 'e', 'w', '{mid}')} < CASE WHEN {_LOW} > 20 THEN 20 ELSE 5 END")}
SELECT image, e AS exposure, w AS whites, CASE WHEN {_LOW} > 20 OR {_LOW} < 2 THEN round(k_found, 1) ELSE 0 END AS blacks FROM k""")
def auto_tone(spark: SparkSession, d: str) -> DataFrame:
    """Sliders of fifty pictures that all embeddings make up."""
    bins = rasters(spark, d).select((F.col("vec_id") % 50).alias("image"), F.explode("p").alias("bin")).groupBy("image", "bin").count()
    held = bins.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"))
    histogram = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long")))
    return fit.auto_tone(held.select("image", histogram.alias("histogram"))).select("image", "exposure", "whites", "blacks")


@query(f"""WITH {EMB}, c AS (SELECT vec_id AS patch, label AS chart, a FROM e) SELECT chart, patch, {', '.join(f'greatest(0, least(1, abs(a[{i + 1}]) * 4)) AS {k}' for i, k in enumerate('rgb'))},
{', '.join(f'greatest(0.001, greatest(0, least(1, abs(a[{i + 1}]) * 4)) * {0.9 - i / 10} + 0.05 * greatest(0, least(1, abs(a[{(i + 1) % 3 + 1}]) * 4)) + 0.01 * abs(a[{i + 4}])) AS target_{k}' for i, k in enumerate('rgb'))}, CASE WHEN patch % 3 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM c""")
def look_patches(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as patches of colour charts, with what a camera makes of them."""
    own = colours(spark, d).join(rasters(spark, d).select("vec_id", "label", "a"), "vec_id")
    names = ("r", "g", "b")
    target = lambda i: F.greatest(F.lit(0.001), F.col(names[i]) * (0.9 - i / 10) + 0.05 * F.col(names[(i + 1) % 3]) + 0.01 * F.abs(F.col("a")[i + 3]))
    return own.select(F.col("label").alias("chart"), F.col("vec_id").alias("patch"), *names, *(target(i).alias(f"target_{n}") for i, n in enumerate(names)), F.when(F.col("vec_id") % 3 == 0, 2.0).otherwise(1.0).alias("weight"))


@query()
def look_fit(spark: SparkSession, d: str) -> DataFrame:
    """The colour matrix of each chart; held against a dense fit in the tests."""
    got = fit.fit_matrices(look_patches(spark, d))
    return got.select("chart", F.transform("matrix", lambda x: F.round(x, 6)).alias("matrix"))


# Colour functions on their own


def _dot(row: tuple, names: tuple) -> str:
    return " + ".join(f"({k}) * {n}" for k, n in zip(row, names, strict=True))


def _rows(matrix: tuple, into: str, names: tuple, wrap: str = "{}") -> str:
    return ", ".join(f"{wrap.format(_dot(row, names))} AS {n}" for row, n in zip(matrix, into, strict=True))


_TURN = math.radians(30)


@query(f"""WITH {RGB}, m AS (SELECT vec_id, {_rows(colour.TO_LMS, "uvw", ("r", "g", "b"), "cbrt({})")} FROM c), o AS (SELECT vec_id, {_rows(colour.LMS_TO_LAB, "lxy", ("u", "v", "w"))} FROM m),
t AS (SELECT vec_id, l, x * {math.cos(_TURN)!r} - y * {math.sin(_TURN)!r} AS x, x * {math.sin(_TURN)!r} + y * {math.cos(_TURN)!r} AS y FROM o), p AS (SELECT vec_id, {_rows(colour.LAB_TO_LMS, "uvw", ("l", "x", "y"), "pow({}, 3)")} FROM t)
SELECT vec_id, {", ".join(f"round({_dot(row, ('u', 'v', 'w'))}, 5) AS {n}" for row, n in zip(colour.FROM_LMS, ("turned_r", "turned_g", "turned_b"), strict=True))} FROM p""")
def hue_turn(spark: SparkSession, d: str) -> DataFrame:
    """Colours with their hue turned by 30 degrees in a perceptual space, and back."""
    turned = colour.from_oklab(*colour.rotate_hue(*colour.oklab(F.col("r"), F.col("g"), F.col("b")), 30.0))
    return colours(spark, d).select("vec_id", *(F.round(v, 5).alias(f"turned_{n}") for v, n in zip(turned, "rgb", strict=True)))


def _f(v: str, n: float) -> str:
    return f"CASE WHEN {v} / {n} > {colour.LAB_EPS!r} THEN cbrt({v} / {n}) ELSE ({colour.LAB_KAPPA!r} * ({v} / {n}) + 16) / 116 END"


@query(f"WITH {RGB}, f AS (SELECT vec_id, {', '.join(f'{_f(v, n)} AS f{v}' for v, n in zip('rgb', colour.D50, strict=True))} FROM c) SELECT vec_id, round(116 * fg - 16, 5) AS light, round(500 * (fr - fg), 5) AS a, round(200 * (fg - fb), 5) AS b FROM f")
def xyz_lab(spark: SparkSession, d: str) -> DataFrame:
    """Three components read as XYZ, in Lab."""
    lab = colour.xyz_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return colours(spark, d).select("vec_id", *(F.round(v, 5).alias(n) for v, n in zip(lab, ("light", "a", "b"), strict=True)))


_BANDS = (0, 30, 60, 120, 180, 240, 280, 320)


def _band(k: int) -> str:
    c, left, right = _BANDS[k], (_BANDS[k] - _BANDS[k - 1]) % 360, (_BANDS[(k + 1) % 8] - _BANDS[k]) % 360
    up, down = f"((h - {c} + 360) % 360)", f"(({c} - h + 720) % 360)"
    return f"CASE WHEN {up} < {right} THEN 0.5 + 0.5 * cos(pi() * {up} / {right}) WHEN {down} < {left} THEN 0.5 + 0.5 * cos(pi() * {down} / {left}) ELSE 0 END"


@query(f"WITH {RGB}, h AS (SELECT vec_id, r * 360 AS h FROM c) SELECT vec_id, {', '.join(f'round({_band(k)}, 6) AS w{k}' for k in range(8))} FROM h")
def hue_bands(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the eight hue bands."""
    w = colour.band_weights(F.col("r") * 360, _BANDS)
    return colours(spark, d).select("vec_id", *(F.round(w[k], 6).alias(f"w{k}") for k in range(8)))


@query(f"WITH {RGB} SELECT vec_id, round(1 + (b - 0.5) * {_smooth(0.5, 1.0, 'sqrt(r * r + g * g)')}, 6) AS gain FROM c")
def vignette_gain(spark: SparkSession, d: str) -> DataFrame:
    gain = colour.radial_gain(F.col("r"), F.col("g"), F.col("b") - 0.5)
    return colours(spark, d).select("vec_id", F.round(gain, 6).alias("gain"))


_TABLE = (0.0, 0.1, 0.35, 0.8, 1.0)


@query(f"WITH {RGB}, p AS (SELECT vec_id, greatest(0, least(1, r)) * 4 AS spot, CAST(least(floor(greatest(0, least(1, r)) * 4), 4) AS INTEGER) AS k FROM c), t AS (SELECT [{', '.join(f'{v}::DOUBLE' for v in _TABLE)}] AS t) SELECT vec_id, round(t[k + 1] + (t[least(k + 1, 4) + 1] - t[k + 1]) * (spot - k), 6) AS value FROM p, t")
def evenly_spaced_table(spark: SparkSession, d: str) -> DataFrame:
    """Values through a small table, interpolated."""
    value = colour.lookup_lerp(F.array(*map(F.lit, _TABLE)), F.col("r"))
    return colours(spark, d).select("vec_id", F.round(value, 6).alias("value"))


@query(f"WITH {RGB} SELECT vec_id, round(greatest(greatest(0, r) * (1 - g), 0.25) * b, 6) AS coverage FROM c")
def mask_components(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of a mask's components in order: add, subtract, add, intersect."""
    one = lambda op, v: F.struct(F.lit(op).alias("op"), v.cast("double").alias("value"))
    made = arrays.compose_mask(F.array(one("add", F.col("r")), one("subtract", F.col("g")), one("add", F.lit(0.25)), one("intersect", F.col("b"))))
    return colours(spark, d).select("vec_id", F.round(made, 6).alias("coverage"))


@query(f"WITH {PIX} SELECT vec_id, CAST(len(p) - list_position(list_reverse(p), list_max(p)) AS INTEGER) AS chosen FROM px")
def object_mask(spark: SparkSession, d: str) -> DataFrame:
    """The candidate with the best score, the last of several."""
    return rasters(spark, d).select("vec_id", arrays.arg_max_last(F.col("p")).cast("int").alias("chosen"))


@query(f"""WITH {PIX}, u AS (SELECT vec_id % 20 AS image, unnest(range(1, len(p) - 1)) AS i, p FROM px), x AS (SELECT image, p[i] AS r, p[i + 1] AS g, p[i + 2] AS b FROM u),
v AS (SELECT image, 'r' AS channel, r AS v FROM x UNION ALL SELECT image, 'g', g FROM x UNION ALL SELECT image, 'b', b FROM x UNION ALL SELECT image, 'luma', (2126 * r + 7152 * g + 722 * b + 5000) // 10000 FROM x)
SELECT image, channel, list_transform(range(256), lambda k: len(list_filter(list(v), lambda y: y = k))) AS histogram, count(*) FILTER (WHERE v <= 100) AS shadows, count(*) FILTER (WHERE v >= 155) AS highlights FROM v GROUP BY image, channel""")
def histogram_channels(spark: SparkSession, d: str) -> DataFrame:
    """Four channels at once, with their clip counts: neighbouring values of embeddings as red, green and blue."""
    px = rasters(spark, d).select((F.col("vec_id") % 20).alias("image"), "p")
    three = px.select("image", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 3), lambda i: F.struct(F.get("p", i).alias("r"), F.get("p", i + 1).alias("g"), F.get("p", i + 2).alias("b")))).alias("x"))
    return stats.histogram_channels(three.select("image", "x.*"), ["image"], low=100, high=155)


# SQL of queries that had none


def _curve(points: list[tuple[float, float]]) -> str:
    """A monotone cubic as SQL, of r."""
    xs, ys, ms = (v.tolist() for v in tables.monotone_cubic(points))
    out = f"CASE WHEN r <= {xs[0]!r} THEN {ys[0]!r}"
    for k in range(len(xs) - 1):
        h = xs[k + 1] - xs[k]
        t = f"((r - {xs[k]!r}) / {h!r})"
        out += f" WHEN r < {xs[k + 1]!r} THEN {ys[k]!r} + {t} * ({h!r} * {ms[k]!r} + {t} * (3 * ({ys[k + 1] - ys[k]!r}) - {h!r} * ({2 * ms[k] + ms[k + 1]!r}) + {t} * ({h!r} * ({ms[k] + ms[k + 1]!r}) - 2 * ({ys[k + 1] - ys[k]!r}))))"
    return f"greatest(0, least(1, {out} ELSE {ys[-1]!r} END))"


ORACLES["curve_eval"] = f"WITH {RGB} SELECT vec_id, round({_curve([(0, 0), (0.25, 0.2), (0.75, 0.85), (1, 1)])}, 6) AS value FROM c"

ORACLES["colour_difference"] = f"""WITH {EMB}, p AS (SELECT vec_id, a[1] * 100 AS l1, a[2] * 100 AS a1, a[3] * 100 AS b1, a[4] * 100 AS l2, a[5] * 100 AS a2, a[6] * 100 AS b2 FROM e),
g AS (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS cm FROM p), h AS (SELECT *, 0.5 * (1 - sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0::DOUBLE, 7)))) AS g FROM g),
q AS (SELECT vec_id, l1, l2, b1, b2, a1 * (1 + g) AS a1, a2 * (1 + g) AS a2 FROM h), c AS (SELECT *, sqrt(a1 * a1 + b1 * b1) AS c1, sqrt(a2 * a2 + b2 * b2) AS c2, (degrees(atan2(b1, a1)) + 360) % 360 AS h1, (degrees(atan2(b2, a2)) + 360) % 360 AS h2 FROM q),
d AS (SELECT *, l2 - l1 AS dl, c2 - c1 AS dc, CASE WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, (l1 + l2) / 2 AS lm, (c1 + c2) / 2 AS cc,
CASE WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm FROM c),
s AS (SELECT vec_id, dl / (1 + 0.015 * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2))) AS x, dc / (1 + 0.045 * cc) AS y,
2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cc * (1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)))) AS z,
-sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) * 2 * sqrt(pow(cc, 7) / (pow(cc, 7) + pow(25.0::DOUBLE, 7))) AS rt FROM d) SELECT vec_id, round(sqrt(greatest(0, x * x + y * y + z * z + rt * y * z)), 4) AS difference FROM s"""
