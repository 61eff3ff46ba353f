"""Places and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres; tolerances of a position in degrees and metres.
EARTH_M = 6_371_008.8
SAME_DEGREES, SAME_METRES = 1e-6, 0.5


def metres_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def same_position(lat1: Column, lon1: Column, ele1: Column, lat2: Column, lon2: Column, ele2: Column) -> Column:
    """Within tolerance; a missing height equals only a missing height."""
    height = F.when(ele1.isNull() | ele2.isNull(), ele1.isNull() & ele2.isNull()).otherwise(F.abs(ele1 - ele2) <= SAME_METRES)
    return (F.abs(lat1 - lat2) <= SAME_DEGREES) & (F.abs(lon1 - lon2) <= SAME_DEGREES) & height


def in_range(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def fit_megapixels(width: Column, height: Column, limit: Column | float) -> Column:
    """struct<width, height> of an image brought down to limit megapixels; null if it fits already or the limit is 0."""
    pixels = width.cast("double") * height
    scale = F.sqrt(F.lit(limit) * 1e6 / pixels) if not isinstance(limit, Column) else F.sqrt(limit * 1e6 / pixels)
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    size = lambda x: F.greatest(F.floor(x * scale).cast("int"), F.lit(1))
    return F.when((limit > 0) & (pixels > limit * 1e6), F.struct(size(width).alias("width"), size(height).alias("height")))


def fit_edge(width: Column, height: Column, edge: int) -> Column:
    """struct<width, height> with the longer edge at most `edge`."""
    scale = F.least(F.lit(1.0), edge / F.greatest(width, height).cast("double"))
    size = lambda x: F.greatest(F.floor(x * scale + 1e-9).cast("int"), F.lit(1))
    return F.struct(size(width).alias("width"), size(height).alias("height"))


def grid_cell(index: Column, columns: Column | int, cell_w: Column | int, cell_h: Column | int, gap: Column | int) -> Column:
    """struct<x, y> of a numbered cell of a grid."""
    return F.struct(((index % columns) * (cell_w + gap)).cast("long").alias("x"), (F.floor(index / columns) * (cell_h + gap)).cast("long").alias("y"))


def print_canvas(width: Column, height: Column, canvas_width: Column | int) -> Column:
    """struct<width, height> of the canvas at a width: 4:5 for what is taller than wide, else 5:4."""
    w = F.greatest(canvas_width if isinstance(canvas_width, Column) else F.lit(canvas_width), F.lit(1)).cast("long")
    return F.struct(w.alias("width"), F.when(height > width, F.floor(w * 5 / 4)).otherwise(F.floor(w * 4 / 5)).alias("height"))


def exif_position(at: Column, lat: Column, lon: Column, ele: Column, with_altitude: bool = True) -> Column:
    """struct of the texts that a photograph's position fields take; sides by letter, below sea level as 1, instants in UTC."""
    side = lambda x, below, above: F.when(x < 0, below).otherwise(above)
    ele = ele if with_altitude else F.lit(None).cast("double")
    utc = F.timestamp_seconds(at)
    return F.struct(
        F.format_string("%.7f", F.abs(lat)).alias("latitude"),
        side(lat, "S", "N").alias("latitude_ref"),
        F.format_string("%.7f", F.abs(lon)).alias("longitude"),
        side(lon, "W", "E").alias("longitude_ref"),
        F.when(ele.isNotNull(), F.format_string("%.3f", F.abs(ele))).alias("altitude"),
        F.when(ele.isNotNull(), (ele < 0).cast("int")).alias("altitude_ref"),
        F.date_format(utc, "yyyy:MM:dd").alias("date_stamp"),
        F.date_format(utc, "HH:mm:ss").alias("time_stamp"),
    )


def geo_status(has_date: Column, has_position: Column, is_video: Column) -> Column:
    """What a file lacks."""
    return F.when(is_video, "not_supported").when(has_date & has_position, "ok").when(has_date, "no_location").when(has_position, "no_date").otherwise("no_date_or_location")


def stored_place(x: Column, y: Column, width: Column, height: Column, turns: Column, flip_x: Column, flip_y: Column, orientation: Column, degrees: Column | float = 0.0) -> Column:
    """struct<x, y>: where a pixel of the edited picture lies in the stored one.

    width and height are those of the picture after its quarter turns; the edit
    turned it by degrees around its centre, flipped it, turned it by quarters,
    and the file's orientation (1 to 8) came first.
    """
    t = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    rx, ry = x - width / 2, y - height / 2
    ax, ay = width / 2 + rx * F.cos(t) + ry * F.sin(t), height / 2 - rx * F.sin(t) + ry * F.cos(t)
    ax, ay = F.when(flip_x, width - ax).otherwise(ax), F.when(flip_y, height - ay).otherwise(ay)
    odd = turns % 2 == 1
    w, h = F.when(odd, height).otherwise(width), F.when(odd, width).otherwise(height)  # before the quarter turns

    def pick(key: Column, *cases: tuple[Column, Column]) -> tuple[Column, Column]:
        out = []
        for side in (0, 1):
            c = F.lit(None).cast("double")
            for k, case in enumerate(cases):
                c = F.when(key == k, case[side]).otherwise(c)
            out.append(c)
        return out[0], out[1]

    ux, uy = pick(turns, (ax, ay), (ay, h - ax), (w - ax, h - ay), (w - ay, ax))
    tall = orientation >= 5
    sw, sh = F.when(tall, h).otherwise(w), F.when(tall, w).otherwise(h)
    sx, sy = pick(orientation - 1, (ux, uy), (sw - ux, uy), (sw - ux, sh - uy), (ux, sh - uy), (uy, ux), (uy, sh - ux), (sw - uy, sh - ux), (sw - uy, ux))
    return F.struct(sx.alias("x"), sy.alias("y"))


def inscribed(width: Column, height: Column, degrees: Column) -> Column:
    """struct<width, height> of the largest upright rectangle inside a rotated one."""
    s, c = F.abs(F.sin(F.radians(degrees))), F.abs(F.cos(F.radians(degrees)))
    long_, short = F.greatest(width, height), F.least(width, height)
    half = short <= 2 * s * c * long_
    x = F.when(half | (F.abs(s - c) < 1e-10), 0.5 * short)
    cos2 = c * c - s * s
    w = F.when(x.isNotNull(), F.when(width >= height, x / s).otherwise(x / c)).otherwise((width * c - height * s) / cos2)
    h = F.when(x.isNotNull(), F.when(width >= height, x / c).otherwise(x / s)).otherwise((height * c - width * s) / cos2)
    return F.struct(F.when(s < 1e-12, width).otherwise(w).alias("width"), F.when(s < 1e-12, height).otherwise(h).alias("height"))
