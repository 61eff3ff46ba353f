"""Facts from the head of a JPEG: size, camera, dates and whether it has a place."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import best_date, utc_offset_minutes
from ..session import ship

#: Numbers of the tags that are read, by directory.
MAIN = {0x0110: "model", 0x0112: "orientation", 0x0132: "modified"}
DETAIL = {0x9003: "original", 0x9004: "digitised", 0x9010: "offset", 0x9011: "offset_original"}
DETAIL_AT, PLACE_AT = 0x8769, 0x8825
TEXTS = ("model", "modified", "original", "digitised", "offset", "offset_original")


def _directory(tiff: bytes, at: int, order: str, wanted: dict[int, str], out: dict) -> dict[int, int]:
    """Reads one directory into out; gives places of the directories that it points to."""
    more: dict[int, int] = {}
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        field = at + 10 + 12 * k
        if tag in (DETAIL_AT, PLACE_AT):
            (more[tag],) = struct.unpack_from(order + "I", tiff, field)
        elif tag in wanted and kind == 2:
            start = field if count <= 4 else struct.unpack_from(order + "I", tiff, field)[0]
            out[wanted[tag]] = tiff[start : start + count].split(b"\0")[0].decode("latin-1").strip()
        elif tag in wanted and kind == 3:
            (out[wanted[tag]],) = struct.unpack_from(order + "H", tiff, field)
    return more


def read_head(body: bytes) -> dict:
    """width, height, orientation, has_location and texts of a JPEG; what cannot be read is missing."""
    out: dict = {"has_location": False}
    at = 2 if body[:2] == b"\xff\xd8" else len(body)
    while at + 4 <= len(body) and body[at] == 0xFF and body[at + 1] not in (0xD9, 0xDA):
        marker, (size,) = body[at + 1], struct.unpack_from(">H", body, at + 2)
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(body):
            out["height"], out["width"] = struct.unpack_from(">HH", body, at + 5)
        elif marker == 0xE1 and body[at + 4 : at + 10] == b"Exif\0\0":
            tiff = body[at + 10 : at + 2 + size]
            order = "<" if tiff[:2] == b"II" else ">"
            try:
                more = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order, MAIN, out)
                if DETAIL_AT in more:
                    _directory(tiff, more[DETAIL_AT], order, DETAIL, out)
                out["has_location"] = PLACE_AT in more
            except struct.error:
                pass
        at += 2 + size
    return out


def read_metadata(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """The kept columns with width, height, orientation, camera, has_location, capture (timestamp), capture_tag, offset_minutes.

    files is what Spark's binaryFile reader gives. A file that is no JPEG, or is
    cut short, has nulls.
    """
    ship(files.sparkSession)
    numbers = ("width", "height", "orientation")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [read_head(x or b"") for x in batch.column("__content").to_pylist()]
            columns = [pa.array([h.get(c) for h in heads], pa.int32()) for c in numbers]
            columns += [pa.array([h.get(c) for h in heads], pa.string()) for c in TEXTS] + [pa.array([h["has_location"] for h in heads])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *numbers, *TEXTS, "has_location"])

    rows = files.select(*keep, F.col(content).alias("__content"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"{c} int" for c in numbers] + [f"{c} string" for c in TEXTS] + ["has_location boolean"]
    read = rows.mapInArrow(run, ", ".join(kinds))
    best = best_date({c: F.col(c) for c in ("original", "digitised", "modified")})
    offset = utc_offset_minutes(F.coalesce("offset_original", "offset"))
    return read.select(*keep, *numbers, F.col("model").alias("camera"), "has_location", best["value"].alias("capture"), best["tag"].alias("capture_tag"), offset.alias("offset_minutes"))
