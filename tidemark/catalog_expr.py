"""Queries of column expressions and sources: names, dates, places, colours, rasters, track files. Tables stand in by role as in catalog.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import EMB, EV, POS, RGB, _smooth, colours, events, positions, query, rasters, table
from .functions import colour, dates, geo, text
from .operators import arrays, ledger, shots, stats
from .sources import media, tables, tracks
from .staging import _STAGED, shared_dir


def written(lines: DataFrame, spark: SparkSession, ending: str) -> str:
    """Path of the one text column's rows, each as lines of files in the shared folder."""
    path = f"{shared_dir(spark)}/{ending}-{uuid.uuid4().hex}"
    lines.write.text(path)
    _STAGED[path] = spark
    return path


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'raw' WHEN 2 THEN 'video' WHEN 3 THEN 'jpeg' ELSE 'other' END AS kind, concat('IMG.', p_partkey) AS stem FROM part")
def classify_path(spark: SparkSession, d: str) -> DataFrame:
    """Kinds and stems of paths."""
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*(F.lit(e) for e in (".JPG", ".Cr2", ".m2ts", ".heic", ".txt", ""))), (k % 6 + 1).cast("int"))
    path = F.concat(F.lit("DCIM/IMG."), k, F.when(ext == "", ".x").otherwise(ext))
    return table(spark, d, "part").select("p_partkey", text.media_kind(path).alias("kind"), text.stem(path).alias("stem"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN concat(p_partkey, '-2024') END AS date_block, CASE WHEN p_partkey % 3 = 0 THEN concat('p', p_partkey, '.jpg') END AS base, CASE WHEN p_partkey % 3 = 0 THEN '7' END AS number,
CASE WHEN length(concat(repeat('x', CAST(p_partkey % 40 AS INTEGER)), '.jpeg')) <= 28 THEN concat(repeat('x', CAST(p_partkey % 40 AS INTEGER)), '.jpeg') ELSE 'xxxxxxxxxxxxxxxxxx....jpeg' END AS caption,
CASE WHEN p_partkey % 4 > 1 THEN concat('f_p', lpad(CAST(p_partkey % 9 + 1 AS VARCHAR), 3, '0'), '.jpg') ELSE 'f.jpg' END AS page, concat('a&amp;b&lt;', p_partkey) AS xml, concat('n ', p_partkey, '-v-', CASE WHEN p_partkey % 2 = 0 THEN '_edit' ELSE '' END) AS filled FROM part""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Date blocks, numbers of copies, captions, names of pages, XML and filled templates."""
    k = F.col("p_partkey")
    dup = text.duplicate_suffix(F.concat(F.lit("p"), k, F.when(k % 3 == 0, "(7)").otherwise("(a)"), F.lit(".jpg")))
    return table(spark, d, "part").select(
        k.alias("k"),
        text.sanitise_date(F.when(k % 4 == 0, F.concat(k, F.lit("/-2024 "))).otherwise("1-2")).alias("date_block"),
        dup["name"].alias("base"),
        dup["number"].alias("number"),
        text.shorten_caption(F.concat(F.repeat(F.lit("x"), (k % 40).cast("int")), F.lit(".jpeg"))).alias("caption"),
        text.page_name(F.lit("f"), k % 9 + 1, k % 4).alias("page"),
        text.xml_escape(F.concat(F.lit("a&b<"), k)).alias("xml"),
        text.fill_template(F.lit("{name}/{version}/{edit}"), name=F.concat(F.lit("n "), k), version=F.lit("v"), edit=F.when(k % 2 == 0, "_edit")).alias("filled"),
    )


@query("""WITH i AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS label, sha256(c_name) AS h FROM customer)
SELECT k, sha256(concat(coalesce(label, ''), chr(0), h)) AS card_id, coalesce(label, concat('fingerprint:', h)) AS scope, sha256(concat(coalesce(label, concat('fingerprint:', h)), chr(0), k)) AS shot_id FROM i""")
def card_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identities of cards and of their shots."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("k"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("label"), F.sha2("c_name", 256).alias("h"))
    scope = text.shot_scope(F.col("label"), F.col("h"))
    return rows.select("k", text.keyed_id(F.col("label"), F.col("h")).alias("card_id"), scope.alias("scope"), text.keyed_id(scope, F.col("k").cast("string")).alias("shot_id"))


@query("SELECT o_orderkey, CASE WHEN b = 0 THEN 'no bytes' WHEN b < 1024 THEN concat(b, ' B') WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END AS size FROM (SELECT o_orderkey, o_orderkey % 7 * o_orderkey * o_custkey AS b FROM orders)")
def human_bytes(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("o_orderkey") % 7 * F.col("o_orderkey") * F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", text.human_bytes(size).alias("size"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'longer than 64 characters' WHEN 2 THEN 'a sign that is not allowed' WHEN 3 THEN 'starts with a dot' END AS problem, CASE p_partkey % 4 WHEN 0 THEN 'cube' WHEN 1 THEN '3dl' WHEN 2 THEN 'hald_png' ELSE 'unknown' END AS format,
CASE p_partkey % 3 WHEN 0 THEN 'No work: no file matched. Subfolders are read only on request.' WHEN 1 THEN concat('No work: ', p_size, ' skipped; first reason: "old".') ELSE concat(p_partkey, ' files, ', p_size, ' failed, 2 skipped') END AS summary FROM part""")
def names_and_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Why a preset may not have a name, formats of colour tables, and closing lines of runs."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda n, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % n + 1).cast("int"))
    line = text.run_summary(F.when(k % 3 == 2, k).otherwise(0), "files", F.when(k % 3 == 2, size).otherwise(0), F.when(k % 3 == 0, 0).when(k % 3 == 1, size).otherwise(2), F.lit("old"))
    return table(spark, d, "part").select(k.alias("k"), text.name_problem(pick(5, "  ", "y" * 65, "a/b", ".a", " a.b ")).alias("problem"), text.table_format(pick(4, "A.CUBE", "b.3dl", "c.png", "d.txt")).alias("format"), line.alias("summary"))


@query("SELECT doc_id, base64(encode(lang)) AS packed, lang AS unpacked, CAST(NULL AS VARCHAR) AS bad, CAST(concat('0x', substr(sha256(lang), 1, 16)) AS UBIGINT)::DOUBLE AS seed FROM documents")
def packed_text(spark: SparkSession, d: str) -> DataFrame:
    """Base64 both ways, and seeds from hashes."""
    packed = F.base64(F.encode("lang", "utf-8"))
    return table(spark, d, "documents").select("doc_id", packed.alias("packed"), F.decode(text.decode_base64(packed), "utf-8").alias("unpacked"), F.decode(text.decode_base64(F.lit("%%")), "utf-8").alias("bad"), text.seed_of(F.sha2("lang", 256)).cast("double").alias("seed"))


def _said(x: str) -> str:
    return f"""CASE WHEN {x} < 120 THEN concat({x}, ' s') WHEN {x} < 7200 THEN concat({x} // 60, ' min') WHEN {x} < 172800 THEN concat({x} // 3600, ' h', CASE WHEN {x} % 3600 // 60 > 0 THEN concat(' ', {x} % 3600 // 60, ' min') ELSE '' END)
ELSE concat({x} // 86400, ' days', CASE WHEN {x} % 86400 // 3600 > 0 THEN concat(' ', {x} % 86400 // 3600, ' h') ELSE '' END) END"""


@query(f"""WITH {EV} SELECT event_id, {_said("event_id * event_id % 400000")} AS said, strftime(make_timestamp(t_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp, t_at - (event_id % 27 - 12) * 3600 AS instant, CAST(floor((t_at + 19800) / 86400.0) AS BIGINT) * 86400 - 19800 AS day_start,
concat(event_id % 3, ':', event_id % 12, ':', event_id % 28, ' 1:2:', event_id % 60) AS magnitude FROM ev""")
def date_texts(spark: SparkSession, d: str) -> DataFrame:
    """Spans as they are said, instants written and read, starts of local days, shifts without their sign."""
    k, at = F.col("event_id"), F.col("at")
    hours = k % 27 - 12
    zone = F.concat(F.when(hours < 0, "-").otherwise("+"), F.lpad(F.abs(hours).cast("string"), 2, "0"), F.lit(":00"))
    local = F.concat(F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".75"), zone)
    shift = F.concat(F.lit("-"), k % 3, F.lit(":"), k % 12, F.lit(":"), k % 28, F.lit(" 1:2:"), k % 60)
    return events(spark, d).select("event_id", dates.duration(k * k % 400_000).alias("said"), dates.rfc3339(at).alias("stamp"), dates.instant(local).alias("instant"), dates.day_start(at, 19_800).alias("day_start"), dates.shift_magnitude(dates.shift_parts(shift)).alias("magnitude"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE epoch_us(o_orderdate) // 1000000 END AS at_s, CASE o_orderkey % 3 WHEN 1 THEN 'original' WHEN 2 THEN 'created' END AS tag FROM orders")
def best_date(spark: SparkSession, d: str) -> DataFrame:
    """The first tag in order whose date can be read, and which it was."""
    k = F.col("o_orderkey")
    when = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    best = dates.best_date({"original": F.when(k % 3 == 1, when).otherwise("0000:00:00 00:00:00"), "created": F.when(k % 3 == 2, when), "modified": F.lit("soon")})
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(best["value"]).alias("at_s"), best["tag"].alias("tag"))


@query(f"""WITH {POS} SELECT event_id, printf('%.7f', abs(lat)) AS latitude, CASE WHEN lat < 0 THEN 'S' ELSE 'N' END AS latitude_ref, printf('%.7f', abs(lon)) AS longitude, CASE WHEN lon < 0 THEN 'W' ELSE 'E' END AS longitude_ref,
CASE WHEN ele IS NOT NULL THEN printf('%.3f', abs(ele - 250)) END AS altitude, CAST(ele - 250 < 0 AS INTEGER) AS altitude_ref, strftime(make_timestamp(t_at * 1000000), '%Y:%m:%d') AS date_stamp, strftime(make_timestamp(t_at * 1000000), '%H:%M:%S') AS time_stamp FROM pos""")
def exif_position(spark: SparkSession, d: str) -> DataFrame:
    """Fixes as a photograph's position fields."""
    return positions(spark, d).select("event_id", geo.exif_position(F.col("at"), F.col("lat"), F.col("lon"), F.col("ele") - 250).alias("p")).select("event_id", "p.*")


@query("""WITH s AS (SELECT p_partkey AS k, p_partkey % 97 + 1 AS w, p_partkey % 61 + 1 AS h FROM part)
SELECT k, 3000 AS canvas_w, CASE WHEN h > w THEN 3750 ELSE 2400 END AS canvas_h, k % 5 * 110 + 0 AS cell_x, k // 5 * 210 AS cell_y, CASE WHEN greatest(w, h) <= 50 THEN w ELSE greatest(1, CAST(floor(w * (50 / greatest(w, h)) + 1e-9) AS INTEGER)) END AS edge_w, CASE WHEN greatest(w, h) <= 50 THEN h ELSE greatest(1, CAST(floor(h * (50 / greatest(w, h)) + 1e-9) AS INTEGER)) END AS edge_h FROM s""")
def layouts(spark: SparkSession, d: str) -> DataFrame:
    """Canvases, cells of contact sheets, and sizes within an edge."""
    k = F.col("p_partkey")
    w, h = k % 97 + 1, k % 61 + 1
    canvas, cell, edge = geo.print_canvas(w, h, 3000), geo.grid_cell(k, 5, 100, 200, 10), geo.fit_edge(w, h, 50)
    return table(spark, d, "part").select(k.alias("k"), canvas["width"].alias("canvas_w"), canvas["height"].alias("canvas_h"), cell["x"].alias("cell_x"), cell["y"].alias("cell_y"), edge["width"].alias("edge_w"), edge["height"].alias("edge_h"))


@query("SELECT p_partkey AS k, round(CASE WHEN p_partkey % 2 = 0 THEN 200.0 ELSE 100.0 END, 6) AS width, round(CASE WHEN p_partkey % 2 = 0 THEN 100.0 ELSE 200.0 END, 6) AS height FROM part")
def inscribed_rect(spark: SparkSession, d: str) -> DataFrame:
    """The upright rectangle inside one turned by nothing or by a right angle's multiple."""
    k = F.col("p_partkey")
    r = geo.inscribed(F.lit(200.0), F.lit(100.0), F.when(k % 2 == 0, 0.0).otherwise(90.0))
    return table(spark, d, "part").select(k.alias("k"), F.round(r["width"], 6).alias("width"), F.round(r["height"], 6).alias("height"))


@query(f"""WITH {RGB} SELECT vec_id, round({_smooth(0.18, 1.0, "r")}, 6) AS whites, round(1 - {_smooth(0.02, 0.18, "r")}, 6) AS blacks, round(CASE WHEN r <= 0.6 THEN 1.25 * r ELSE 1 - 1.5625 * (1 - r) * (1 - r) END, 6) AS base,
round(CASE WHEN r < 1.0 / 512 THEN 16 * r ELSE pow(r, 1 / 1.8) END, 6) AS encoded, round(greatest(0, least(1, r * (2.51 * r + 0.03) / (r * (2.43 * r + 0.59) + 0.14))), 6) AS film, round({_smooth(0.005, 0.025, "g / 20")}, 6) AS fade FROM c""")
def tone_curves(spark: SparkSession, d: str) -> DataFrame:
    """Weights of whites and blacks, fixed tone curves, and the fading of greys."""
    r, g = F.col("r"), F.col("g")
    whites, blacks = colour.white_black_weights(r)
    found = {"whites": whites, "blacks": blacks, "base": colour.base_tone(r), "encoded": colour.prophoto_encode(r), "film": colour.filmic(r), "fade": colour.chroma_fade(g / 20)}
    return colours(spark, d).select("vec_id", *(F.round(v, 6).alias(k) for k, v in found.items()))


@query(f"""WITH {RGB}, q AS (SELECT vec_id, r, 0.33 + 0.04 AS c1, 0.67 + 0.04 AS c2, 0.125 AS h FROM c), w AS (SELECT vec_id, 1 - (1 - cos(pi() * greatest(0, least(1, (r - c1 + h) / (2 * h))))) / 2 AS s, (1 - cos(pi() * greatest(0, least(1, (r - c2 + h) / (2 * h))))) / 2 AS t FROM q)
SELECT vec_id, round(s * (1 - t), 6) AS shadows, round(greatest(0, 1 - s * (1 - t) - t * (1 - s)), 6) AS midtones, round(t * (1 - s), 6) AS highlights FROM w""")
def range_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of shadows, midtones and highlights."""
    parts = colour.range_weights(F.col("r"), F.lit(20.0), F.lit(50.0))
    return colours(spark, d).select("vec_id", *(F.round(v, 6).alias(k) for k, v in zip(("shadows", "midtones", "highlights"), parts, strict=True)))


@query(f"""WITH {RGB}, q AS (SELECT vec_id, r * 360 AS hue, g AS chroma, b AS light FROM c), w AS (SELECT vec_id, chroma, least(abs(hue - 200), 360 - abs(hue - 200)) / 34.0 AS x, abs(chroma - 0.3) / 0.14 AS y, abs(light - 0.4) / 0.32 AS z FROM q)
SELECT vec_id, round((1 - {_smooth(0.5, 1.0, "x")}) * (1 - {_smooth(0.5, 1.0, "y")}) * (1 - {_smooth(0.5, 1.0, "z")}) * {_smooth(0.005, 0.025, "chroma")}, 6) AS weight FROM w""")
def colour_weight(spark: SparkSession, d: str) -> DataFrame:
    """How much each colour belongs to a picked one."""
    weight = colour.colour_weight(F.col("r") * 360, F.col("g"), F.col("b"), (200.0, 0.3, 0.4), 50.0)
    return colours(spark, d).select("vec_id", F.round(weight, 6).alias("weight"))


@query(f"""WITH {RGB}, q AS (SELECT vec_id, r, g, b, CASE WHEN greatest(r, g, b) >= 0.98 THEN 'clipped highlight' WHEN 0.2126 * r + 0.7152 * g + 0.0722 * b < 0.005 THEN 'deep shadow' WHEN least(r, g, b) <= 1e-6 THEN 'near-zero channel' END AS problem FROM c)
SELECT vec_id, problem, CASE WHEN problem IS NULL THEN round(greatest(-100, least(100, 100 * log2(b / r))), 4) END AS temperature, CASE WHEN problem IS NULL THEN round(greatest(-100, least(100, 100 * log2(g * g / (r * b)))), 4) END AS tint, CASE WHEN problem IS NULL THEN abs(100 * log2(b / r)) > 100 OR abs(100 * log2(g * g / (r * b))) > 100 END AS clamped FROM q""")
def white_balance(spark: SparkSession, d: str) -> DataFrame:
    """What makes a picked colour grey."""
    got = colours(spark, d).select("vec_id", colour.white_balance(F.col("r"), F.col("g"), F.col("b")).alias("w")).select("vec_id", "w.*")
    return got.withColumns({c: F.round(c, 4) for c in ("temperature", "tint")})


@query(f"""WITH {RGB}, l AS (SELECT vec_id % 25 AS patch, list_sort(list(r)) AS r, list_sort(list(g)) AS g, list_sort(list(b)) AS b, len(list(r)) AS n FROM c GROUP BY 1)
SELECT patch, {", ".join(f"round(CASE WHEN n % 2 = 0 THEN ({x}[n // 2] + {x}[n // 2 + 1]) / 2 ELSE {x}[n // 2 + 1] END, 6) AS {x}_median" for x in "rgb")}, CASE {" ".join(f"WHEN {x}[CAST(floor(n * 0.75) AS BIGINT) + 1] - {x}[CAST(floor(n * 0.25) AS BIGINT) + 1] > 0.1 THEN '{x}'" for x in "rgb")} END AS problem FROM l""")
def patch_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians of small boxes of pixels, and boxes whose values lie too far apart."""
    pixels = colours(spark, d).withColumn("patch", F.col("vec_id") % 25)
    got = arrays.patch_medians(pixels, ["patch"], ["r", "g", "b"])
    return got.select("patch", *(F.round(f"{c}_median", 6).alias(f"{c}_median") for c in "rgb"), "problem")


@query(f"""WITH {RGB}, q AS (SELECT vec_id // 4 AS chart, list_sort(list(g / r) FILTER (WHERE r > 1e-6)) AS v FROM c GROUP BY 1) SELECT chart, round(CASE WHEN coalesce(len(v), 0) = 0 THEN 1.0 WHEN len(v) = 4 THEN (v[2] + v[3]) / 2 ELSE v[len(v) // 2 + 1] END, 4) AS gain FROM q""")
def exposure_gain(spark: SparkSession, d: str) -> DataFrame:
    """What brings each chart's grey patches to their targets."""
    rows = colours(spark, d).withColumn("chart", F.floor(F.col("vec_id") / 4))
    return rows.groupBy("chart").agg(F.round(colour.exposure_gain(F.col("r"), F.col("g")), 4).alias("gain"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN round(1 / (p_size + 1.0), 6) END AS m00, CASE WHEN p_partkey % 2 = 0 THEN 0.5 END AS m11, CASE WHEN p_partkey % 2 = 0 THEN round(-1 / (p_size + 1.0), 6) END AS m20, CASE WHEN p_partkey % 2 = 0 THEN 1.0 END AS m22 FROM part")
def invert_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Inverses of 3 x 3 matrices, null for singular ones."""
    one, zero, n = F.lit(1.0), F.lit(0.0), F.col("p_size") + F.lit(1.0)
    two = F.when(F.col("p_partkey") % 2 == 0, 2.0).otherwise(0.0)
    m = colour.invert_3x3([[n, zero, zero], [zero, two, zero], [one, zero, one]])
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), *(F.round(m[i][j], 6).alias(f"m{i}{j}") for i, j in ((0, 0), (1, 1), (2, 0), (2, 2))))


@query(f"WITH {EMB} SELECT vec_id, round(list_sum(a) / len(a), 6) AS mean, len(list_filter(a, lambda x: x >= 0.2)) / len(a) > 0.3 OR len(list_filter(a, lambda x: x <= -0.2)) / len(a) > 0.3 AS is_border, list_position(a[1:8], list_max(a[1:8])) - 1 AS best FROM e")
def line_facts(spark: SparkSession, d: str) -> DataFrame:
    """Means of lines, which of them are border, and the first largest of eight classes."""
    a = F.col("a")
    return rasters(spark, d).select("vec_id", F.round(arrays.row_mean(a), 6).alias("mean"), arrays.is_border_line(a, -0.2, 0.2, 0.3).alias("is_border"), arrays.first_largest(F.slice(a, 1, 8)).alias("best"))


@query(f"WITH {EMB}, g AS (SELECT vec_id % 10 AS scene, list_position(a[1:4], list_max(a[1:4])) - 1 = 2 AS sky FROM e) SELECT scene, avg(CASE WHEN sky THEN 1.0 ELSE 0.0 END) >= 0.3 AS has_sky FROM g GROUP BY scene")
def scene_has_sky(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of whose cells a share has its largest class at place 2."""
    sky = (arrays.first_largest(F.slice("a", 1, 4)) == 2).cast("double")
    return rasters(spark, d).groupBy((F.col("vec_id") % 10).alias("scene")).agg((F.avg(sky) >= 0.3).alias("has_sky"))


@query(f"""WITH {EMB}, f AS (SELECT vec_id, list_transform(range(8), lambda x: len(list_filter(range(8), lambda y: a[y * 8 + x + 1] <= 0.1)) / 8 <= 0.6) AS cx, list_transform(range(8), lambda y: len(list_filter(a[y * 8 + 1 : y * 8 + 8], lambda v: v <= 0.1)) / 8 <= 0.6) AS cy FROM e),
r AS (SELECT vec_id, {", ".join(f"least(coalesce(list_position({s}, true) - 1, 8), 3, 7) AS {s}0, least(coalesce(list_position(list_reverse({s}), true) - 1, 8), 3) AS {s}1" for s in ("cx", "cy"))} FROM f), b AS (SELECT vec_id, cx0, greatest(8 - cx1, cx0 + 1) AS cx9, cy0, greatest(8 - cy1, cy0 + 1) AS cy9 FROM r)
SELECT vec_id, CAST(least(cx0 + 1, cx9) AS INTEGER) AS "left", CAST(least(cy0 + 1, cy9) AS INTEGER) AS top, CAST(greatest(cx9 - 1, cx0) AS INTEGER) AS "right", CAST(greatest(cy9 - 1, cy0) AS INTEGER) AS bottom FROM b""")
def trim_dark_edges(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 rasters without dark edges of up to three lines a side."""
    box = arrays.trim_dark_edges(F.col("a"), F.lit(8), F.lit(8), 0.1, 0.6, 3, 1)
    return rasters(spark, d).select("vec_id", box.alias("b")).select("vec_id", "b.*")


@query(f"WITH {EMB} SELECT vec_id, round(greatest(a[1], 0) * a[4] + greatest(a[2], 0) * a[6], 6) AS x, round(greatest(a[1], 0) * a[5] + greatest(a[2], 0) * a[7], 6) AS y FROM e")
def local_adjustments(spark: SparkSession, d: str) -> DataFrame:
    """Sums of masks' adjustments by their weights."""
    a = F.col("a")
    total = arrays.weighted_sum(F.slice(a, 1, 2), F.array(F.slice(a, 4, 2), F.slice(a, 6, 2)))
    return rasters(spark, d).select("vec_id", F.round(total[0], 6).alias("x"), F.round(total[1], 6).alias("y"))


@query(f"""WITH {EMB}, p AS (SELECT vec_id, a, greatest(0, least(7, (vec_id % 11) / 10 * 8 - 0.5)) AS x, greatest(0, least(7, (vec_id % 7) / 6 * 8 - 0.5)) AS y FROM e), q AS (SELECT *, CAST(floor(x) AS INTEGER) AS x0, CAST(floor(y) AS INTEGER) AS y0, least(CAST(floor(x) AS INTEGER) + 1, 7) AS x1, least(CAST(floor(y) AS INTEGER) + 1, 7) AS y1 FROM p)
SELECT vec_id, round((a[y0 * 8 + x0 + 1] * (1 - x + x0) + a[y0 * 8 + x1 + 1] * (x - x0)) * (1 - y + y0) + (a[y1 * 8 + x0 + 1] * (1 - x + x0) + a[y1 * 8 + x1 + 1] * (x - x0)) * (y - y0), 6) AS value FROM q""")
def bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    """An 8 x 8 grid between its cells."""
    k = F.col("vec_id")
    return rasters(spark, d).select("vec_id", F.round(arrays.bilinear(F.col("a"), 8, 8, k % 11 / 10, k % 7 / 6), 6).alias("value"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 3 THEN 'unsupported version' WHEN p_partkey % 4 = 2 THEN 'malformed' END AS problem, CASE WHEN p_partkey % 4 = 0 THEN 1 WHEN p_partkey % 4 = 1 THEN 2 END AS version, CASE WHEN p_partkey % 4 < 2 THEN p_size / 10.0 END AS exposure, CASE WHEN p_partkey % 4 < 2 THEN 0.0 END AS contrast FROM part")
def load_recipe(spark: SparkSession, d: str) -> DataFrame:
    """Recipes in JSON: absent fields have defaults, a missing version is 1, a newer one is refused."""
    k = F.col("p_partkey")
    body = F.concat(F.lit('{"exposure": '), (F.col("p_size") / 10).cast("string"), F.when(k % 4 == 1, ', "version": 2').when(k % 4 == 3, ', "version": 9').otherwise(""), F.lit("}"))
    return table(spark, d, "part").select(k.alias("k"), tables.recipe(F.when(k % 4 == 2, "{").otherwise(body)).alias("r")).select("k", "r.problem", "r.version", "r.exposure", "r.contrast")


@query("""SELECT p_partkey AS k, sha256(concat('{"version":2,"exposure":', p_size // 10, '.5,"contrast":0.0}')) AS recipe_sha256 FROM part""")
def recipe_sha256(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of recipes: neither the photograph that they were made on nor their version counts."""
    k = F.col("p_partkey")
    body = F.concat(F.lit('{"contrast": 0, "exposure": '), F.floor(F.col("p_size") / 10), F.lit('.5, "source_sha256": "'), k, F.when(k % 2 == 0, '", "version": 2}').otherwise('"}'))
    return table(spark, d, "part").select(k.alias("k"), tables.recipe_sha256(tables.recipe(body)).alias("recipe_sha256"))


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'neutral' WHEN 1 THEN 'film' WHEN 2 THEN 'builtin' ELSE 'library' END AS source, CASE p_partkey % 4 WHEN 0 THEN NULL ELSE concat('x', p_partkey) END AS name FROM part")
def resolve_look(spark: SparkSession, d: str) -> DataFrame:
    """Where a look comes from."""
    k = F.col("p_partkey")
    key = F.when(k % 4 == 0, "neutral").otherwise(F.concat(F.when(k % 4 == 1, "film:").when(k % 4 == 2, "builtin:").otherwise(""), F.lit("x"), k))
    return table(spark, d, "part").select(k.alias("k"), tables.look_of(key).alias("l")).select("k", "l.source", "l.name")


# Files: what is written is read again


@query(f"WITH {POS} SELECT user_id, t_at AS at_s, round(min_by(lat, event_id), 7) AS lat, round(min_by(lon, event_id), 7) AS lon, round(min_by(coalesce(ele, -1), event_id), 2) AS ele FROM pos GROUP BY user_id, t_at")
def gpx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each user's track written as a document and read again; one position an instant."""
    first = ledger.one_per_key(positions(spark, d), ["user_id", "at"], ["event_id"])
    path = written(tracks.write_gpx(first, "user_id").select("gpx"), spark, "tracks")
    found = tracks.read_documents(spark.read.text(path).select("value", F.sha2("value", 256).alias("file"))).where("reason is null")
    names = tracks.write_gpx(first, "user_id").select("user_id", "track_id")
    return found.join(names, "track_id").select("user_id", F.col("at").alias("at_s"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round(F.coalesce("ele", F.lit(-1.0)), 2).alias("ele"))


@query(f"WITH {EV}, r AS (SELECT event_id, t_at, value FROM ev) SELECT CASE event_id % 4 WHEN 0 THEN 'fix' WHEN 1 THEN 'ignored' WHEN 2 THEN 'refused' ELSE 'fix' END AS route, count(*) AS n, sum(CASE WHEN event_id % 4 IN (0, 3) THEN t_at ELSE 0 END) AS at_sum FROM r GROUP BY 1")
def device_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports as JSON lines, alone or in arrays, by what becomes of them."""
    k = F.col("event_id")
    one = lambda kind, lat: F.concat(F.lit(f'{{"_type":"{kind}","tst":'), F.col("at"), F.lit(f',"lat":{lat},"lon":7}}'))
    line = F.when(k % 4 == 0, one("location", 5)).when(k % 4 == 1, one("lwt", 5)).when(k % 4 == 2, one("location", 95)).otherwise(F.concat(F.lit("["), one("location", 5), F.lit("]")))
    got = tracks.route_reports(events(spark, d).select(line.alias("value")))
    return got.groupBy("route").agg(F.count("*").alias("n"), F.sum(F.when(F.col("route") == "fix", F.col("at")).otherwise(0)).alias("at_sum"))


@query(f"WITH {EV} SELECT t_at + 60 * (event_id % 50) AS at_s, count(*) > 0 AS found FROM ev WHERE event_id % 3 = 0 GROUP BY 1 UNION SELECT t_at, true FROM ev WHERE event_id % 3 = 1 UNION SELECT t_at + 90, true FROM ev WHERE event_id % 3 = 1")
def timeline_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a timeline in JSON: points along a path, and both ends of a visit."""
    k = F.col("event_id")
    start, end = dates.rfc3339(F.col("at")), dates.rfc3339(F.col("at") + 90)
    path = F.concat(F.lit('{"startTime":"'), start, F.lit('","endTime":"'), end, F.lit('","timelinePath":[{"point":"geo:1,2","durationMinutesOffsetFromStartTime":"'), k % 50, F.lit('"}]}'))
    visit = F.concat(F.lit('{"startTime":"'), start, F.lit('","endTime":"'), end, F.lit('","visit":{"topCandidate":{"placeLocation":"geo:1,2"}}}'))
    lines = events(spark, d).select(F.when(k % 3 == 0, path).when(k % 3 == 1, visit).otherwise('{"activity":{}}').alias("value"))
    got = tracks.read_timeline(spark, written(lines, spark, "timeline"), multi_line=False).where("reason is null")
    return got.select(F.col("at").alias("at_s"), F.lit(True).alias("found")).distinct()


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'timeline' WHEN 1 THEN 'gpx' ELSE 'timeline' END AS format FROM part")
def track_format(spark: SparkSession, d: str) -> DataFrame:
    """What a track's text is, by its first sign."""
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, "  [1]").when(k % 3 == 1, " <gpx/>").otherwise('\n{"a":1}')
    return table(spark, d, "part").select(k.alias("k"), tracks.track_format(value).alias("format"))


@query("""WITH f AS (SELECT concat('D/', p_partkey % 700, CASE p_partkey % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.cr2' ELSE '.txt' END) AS rel_path FROM part) SELECT DISTINCT rel_path, CASE WHEN rel_path LIKE '%.txt' THEN 'not accepted: .txt' END AS reason FROM f""")
def accepted_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs once each; what is not accepted has a reason."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.concat(F.lit("D/"), k % 700, F.when(k % 3 == 0, ".JPG").when(k % 3 == 1, ".cr2").otherwise(".txt")).alias("rel_path"))
    return media.accept(rows, ["jpg", "cr2"]).select("rel_path", "reason")


@query("SELECT CAST(row_number() OVER (ORDER BY is_dir DESC, lower(name), name) - 1 AS BIGINT) AS place, name FROM (SELECT concat(CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'A' END, p_partkey) AS name, p_partkey % 5 = 0 AS is_dir FROM part)")
def list_directory(spark: SparkSession, d: str) -> DataFrame:
    """A folder's entries: folders first, then by name whatever its case."""
    from .staging import with_place

    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.concat(F.when(k % 2 == 0, "b").otherwise("A"), k).alias("name"), (k % 5 == 0).alias("is_dir"))
    return with_place(rows, [F.col("is_dir").desc(), F.lower("name"), "name"])[0].select("place", "name")


@query("SELECT CAST(r.r AS INTEGER) AS i, CAST(g.g AS INTEGER) AS j, CAST(b.b AS INTEGER) AS k, r.r / 4.0 AS r, g.g / 4.0 AS g, 1 - b.b / 4.0 AS b FROM range(5) r(r), range(5) g(g), range(5) b(b)")
def cube_file(spark: SparkSession, d: str) -> DataFrame:  # noqa: ARG001
    """A colour table's text read as a lattice; red runs fastest in it."""
    rows = "\n".join(f"{r / 4} {g / 4} {1 - b / 4}" for b in range(5) for g in range(5) for r in range(5))
    path = written(spark.createDataFrame([(f"LUT_3D_SIZE 5\n{rows}",)], "value string").coalesce(1), spark, "look.cube")
    return tables.read_lattices(spark, path).select("i", "j", "k", "r", "g", "b")


@query("WITH o AS (SELECT o_custkey % 20 AS card, epoch_us(o_orderdate) // 1000000 AS at_s FROM orders), l AS (SELECT card, list_sort(list(at_s)) AS v FROM o GROUP BY card) SELECT card, len(v) AS n, v[len(v) // 2 + 1] AS at_s FROM l")
def median_capture(spark: SparkSession, d: str) -> DataFrame:
    """The upper median of each card's captures."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("card"), dates.seconds(F.col("o_orderdate")).alias("at_s"))
    return stats.upper_median(rows, ["card"], "at_s")


@query("""WITH q AS (SELECT p_partkey AS k, CAST(p_partkey % 40 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_partkey % 4 AS t, p_partkey % 8 + 1 AS o, p_partkey % 3 = 0 AS f FROM part), a AS (SELECT k, CASE WHEN f THEN 40 - x ELSE x END AS x, y, t, o, CASE WHEN t % 2 = 1 THEN 60 ELSE 40 END AS w, CASE WHEN t % 2 = 1 THEN 40 ELSE 60 END AS h FROM q),
u AS (SELECT k, o, w, h, CASE t WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN w - x ELSE w - y END AS x, CASE t WHEN 0 THEN y WHEN 1 THEN h - x WHEN 2 THEN h - y ELSE x END AS y FROM a), s AS (SELECT *, CASE WHEN o >= 5 THEN h ELSE w END AS sw, CASE WHEN o >= 5 THEN w ELSE h END AS sh FROM u)
SELECT k, round(CASE o WHEN 1 THEN x WHEN 2 THEN sw - x WHEN 3 THEN sw - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN y ELSE sw - y END, 6) AS x, round(CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN sh - y WHEN 4 THEN sh - y WHEN 5 THEN x WHEN 6 THEN sh - x WHEN 7 THEN sh - x ELSE x END, 6) AS y FROM s""")
def stored_place(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of turned and flipped pictures in the stored ones."""
    k = F.col("p_partkey")
    at = geo.stored_place((k % 40).cast("double"), F.col("p_size").cast("double"), F.lit(40.0), F.lit(60.0), k % 4, k % 3 == 0, F.lit(False), k % 8 + 1)
    return table(spark, d, "part").select(k.alias("k"), F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


@query("""WITH n AS (SELECT concat('f', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.CR3' WHEN 1 THEN '.jpg' WHEN 2 THEN '.dng' ELSE '.pdf' END) AS name FROM part) SELECT name, name LIKE '%.CR3' OR name LIKE '%.dng' AS is_raw, name NOT LIKE '%.jpg' AS unpublishable FROM n""")
def kinds_of_names(spark: SparkSession, d: str) -> DataFrame:
    """Which of a folder's names are raw files, and which cannot be published."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("f"), k, F.element_at(F.array(*(F.lit(x) for x in (".CR3", ".jpg", ".dng", ".pdf"))), (k % 4 + 1).cast("int")))
    return table(spark, d, "part").select(name.alias("name")).select("name", (text.media_kind(F.col("name")) == "raw").alias("is_raw"), (~text.extension(F.col("name")).isin(text.JPEG)).alias("unpublishable"))


@query("""WITH f AS (SELECT DISTINCT c_custkey % 60 AS scope, upper(concat('img', c_custkey)) AS stem FROM customer), k AS (SELECT DISTINCT c_custkey % 60 AS scope, upper(concat('IMG', c_custkey)) AS stem FROM customer WHERE c_custkey % 60 < 30 AND (c_custkey % 60 < 15 OR c_custkey % 2 = 0))
SELECT scope, count(*) AS shots, count(*) FILTER (WHERE k.stem IS NULL) AS new_shots, scope IN (SELECT scope FROM k) AS seen_before FROM f LEFT JOIN k USING (scope, stem) GROUP BY scope HAVING count(*) FILTER (WHERE k.stem IS NULL) > 0""")
def cards_to_announce(spark: SparkSession, d: str) -> DataFrame:
    """Cards with shots that are not known yet."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select((k % 60).alias("scope"), k.alias("k"))
    known = rows.where("scope < 30 AND (scope < 15 OR k % 2 = 0)").select("scope", F.concat(F.lit("IMG"), "k").alias("stem"))
    return shots.worth_announcing(shots.card_summaries(rows.select("scope", F.concat(F.lit("img"), "k").alias("stem")), known))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'preview' WHEN p_partkey % 3 = 0 THEN 'system' WHEN p_partkey % 5 = 0 THEN 'decoder' END AS rung, CASE WHEN p_partkey % 2 = 0 THEN p_size WHEN p_partkey % 3 = 0 THEN p_size + 100 WHEN p_partkey % 5 = 0 THEN p_size + 200 END AS value,
CASE WHEN p_partkey % 2 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN 'preview: none' WHEN p_partkey % 5 = 0 THEN 'preview: none' ELSE 'preview: none; decoder: failed' END AS reasons FROM part""")
def first_rung(spark: SparkSession, d: str) -> DataFrame:
    """The first of several ways to a picture that gave one, and why those before it did not."""
    k, size, null = F.col("p_partkey"), F.col("p_size"), F.lit(None).cast("string")
    rung = shots.first_rung({"preview": (F.when(k % 2 == 0, size), F.lit("none")), "system": (F.when(k % 3 == 0, size + 100), null), "decoder": (F.when(k % 5 == 0, size + 200), F.lit("failed"))})
    return table(spark, d, "part").select(k.alias("k"), rung.alias("r")).select("k", "r.rung", "r.value", "r.reasons")


@query("SELECT concat('Look ', c_custkey) AS name, c_custkey / 10.0 AS exposure FROM customer WHERE c_custkey % 50 = 7")
def presets(spark: SparkSession, d: str) -> DataFrame:
    """Presets written and listed again, without those whose name or body cannot be used."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").where(k % 50 < 10).select(F.concat(F.when(k % 50 == 7, "Look ").when(k % 50 == 8, "a/").otherwise("bad "), k).alias("name"), F.when(k % 50 == 7, F.concat(F.lit('{"exposure": '), (k / 10).cast("string"), F.lit("}"))).otherwise("{").alias("body"))
    path = f"{shared_dir(spark)}/presets-{uuid.uuid4().hex}"
    _STAGED[path] = spark
    tables.write_presets(rows, path)
    found = spark.read.parquet(path).select("name", tables.recipe(F.col("body")).alias("recipe")).where("recipe.problem is null")
    return found.select("name", F.col("recipe.exposure").alias("exposure"))
