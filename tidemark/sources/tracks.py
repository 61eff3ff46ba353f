"""Track files: GPX documents and timeline JSON, one row per point, bad points with their reason."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import instant
from ..functions.geo import in_range
from ..session import ship
from .documents import GPX_FOOTER, GPX_HEADER, gpx_point

_POINTS = ("trkpt", "wpt", "rtept")
_RAW = "file string, ordinal int, lat string, lon string, ele string, time string, problem string"


def _gpx_rows(text: str) -> Iterator[tuple]:
    """(ordinal, lat, lon, ele, time, problem) of a document's points, in document order."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        yield (None, None, None, None, None, f"not a document: {e}")
        return
    n = 0
    for node in root.iter():
        if node.tag.rpartition("}")[2] in _POINTS:
            parts = {child.tag.rpartition("}")[2]: child.text for child in node}
            yield (n, node.get("lat"), node.get("lon"), parts.get("ele"), parts.get("time"), None)
            n += 1


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """file, track_id (SHA-256 of the text), ordinal, at, lat, lon, ele, reason.

    Points in any namespace; a document that cannot be read is one row with its
    reason. Of several points at one instant the first in the document stays;
    points with a reason all stay.
    """
    ship(spark)
    return read_documents(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")))


def track_format(value):
    """`timeline` for JSON, else `gpx`, by the first sign that is no white space."""
    return F.when(F.regexp_replace(value, r"^\s+", "").rlike(r"^[\[{]"), "timeline").otherwise("gpx")


def read_documents(files: DataFrame) -> DataFrame:
    """The same for documents in rows (value, file)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *r) for f, t in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True) for r in _gpx_rows(t)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "ordinal", "lat", "lon", "ele", "time", "problem"])

    ids = files.select("file", F.sha2("value", 256).alias("track_id"))
    raw = files.mapInArrow(parse, _RAW).join(ids, "file")
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    at = instant(F.col("time"))
    reason = F.coalesce(F.col("problem"), F.when(~in_range(lat, lon), "no position in range").when(at.isNull(), "no time"))
    rows = raw.select("file", "track_id", "ordinal", at.alias("at"), lat.alias("lat"), lon.alias("lon"), F.col("ele").try_cast("double").alias("ele"), reason.alias("reason"))
    return first_per_instant(rows)


def first_per_instant(rows: DataFrame) -> DataFrame:
    """Of the good points of one file and instant, the first; points with a reason as they are."""
    order = Window.partitionBy("file", "at").orderBy("ordinal")
    good = rows.where("reason is null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return good.unionByName(rows.where("reason is not null"))


TIMELINE_SCHEMA = """startTime string, endTime string,
visit struct<topCandidate: struct<placeLocation: string>>,
timelinePath array<struct<point: string, durationMinutesOffsetFromStartTime: string>>"""


def geo_text(x):
    """struct<lat, lon> of `geo:lat,lon`; null if out of range or not such a text."""
    pattern = r"^geo:(-?[0-9.]+),(-?[0-9.]+)$"
    lat, lon = F.regexp_extract(x, pattern, 1).try_cast("double"), F.regexp_extract(x, pattern, 2).try_cast("double")
    return F.when(in_range(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def read_timeline(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """file, ordinal, at, lat, lon, ele, reason of a timeline's segments.

    A path gives its points at the segment's start plus their minutes, a visit
    its place at both ends; other segments give nothing.
    """
    rows = spark.read.schema(TIMELINE_SCHEMA).option("multiLine", multi_line).json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("segment"))
    start, end = instant(F.col("startTime")), instant(F.col("endTime"))
    path_points = rows.select("file", "segment", F.posexplode("timelinePath").alias("place", "p"), start.alias("start")).select(
        "file", "segment", "place", (F.col("start") + F.col("p.durationMinutesOffsetFromStartTime").try_cast("long") * 60).alias("at"), geo_text(F.col("p.point")).alias("g")
    )
    visits = rows.where("visit is not null").select("file", "segment", F.posexplode(F.array(start, end)).alias("place", "at"), geo_text(F.col("visit.topCandidate.placeLocation")).alias("g"))
    both = path_points.unionByName(visits)
    reason = F.when(F.col("g").isNull(), "no position in range").when(F.col("at").isNull(), "no time")
    ordinal = F.row_number().over(Window.partitionBy("file").orderBy("segment", "place"))
    out = both.select("file", ordinal.alias("ordinal"), "at", "g.lat", "g.lon", F.lit(None).cast("double").alias("ele"), reason.alias("reason"))
    return first_per_instant(out)


REPORT_SCHEMA = "_type string, tst long, lat double, lon double, alt double, tid string"


def route_reports(lines: DataFrame, column: str = "value") -> DataFrame:
    """route (fix, ignored, refused) and at, lat, lon, ele, device of device reports, one JSON object or array of them a line.

    Works on streams too.
    """
    is_list = F.ltrim(column).startswith("[")
    one = F.array(F.from_json(column, REPORT_SCHEMA))
    many = F.from_json(column, f"array<struct<{REPORT_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")
    rows = lines.select(F.explode_outer(F.when(is_list, many).otherwise(one)).alias("r"))
    good = in_range(F.col("r.lat"), F.col("r.lon")) & F.col("r.tst").isNotNull()
    route = F.when(F.col("r._type").isNull(), "refused").when(F.col("r._type") != "location", "ignored").when(good, "fix").otherwise("refused")
    return rows.select(route.alias("route"), F.col("r.tst").alias("at"), "r.lat", "r.lon", F.col("r.alt").alias("ele"), F.col("r.tid").alias("device"))


def write_gpx(points: DataFrame, key: str) -> DataFrame:
    """key, gpx (document text, the same for the same points) and track_id (its SHA-256).

    A document is one value here, so a key should be a track or a day;
    documents.write_tracks streams documents of any length to files.
    """
    line = gpx_point(F.col("at"), F.col("lat"), F.col("lon"), F.col("ele"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "")
    text = F.concat(F.lit(GPX_HEADER), body, F.lit(GPX_FOOTER))
    return points.groupBy(key).agg(text.alias("gpx")).withColumn("track_id", F.sha2("gpx", 256))
