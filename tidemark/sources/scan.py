"""One scan of files and folders that ends in dates, sidecars and places."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import in_range
from ..functions.text import base_name, extension, media_kind, sidecar_candidates
from ..operators.repair import sidecar_date
from ..session import ship
from .containers import read_metadata
from .media import entries, file_system

#: Bytes of a sidecar at most; what is longer is no sidecar.
LONGEST = 1 << 20


def expand(inputs: DataFrame, path: str = "path", recursive: bool = True) -> DataFrame:
    """root, path, size, problem of the files that inputs (files and folders, mixed) stand for, each file once.

    root is the input that a file was found by, the first by name if several
    lead to it. Folders are walked by tasks, level by level: every level's
    folders are dealt out anew, so one large folder of folders is no single
    task's. Ignored names and links are left out of folders; an input that is
    not there is a row with a problem. Null inputs give nothing.
    """
    spark = inputs.sparkSession
    ship(spark)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Inputs as they are: files, folders to be walked, and problems."""
        for batch in batches:
            rows = []
            for p in batch.column("path").to_pylist():
                try:
                    fs, at = file_system(p)
                    info = fs.get_file_info(at)
                    kind = {FileType.Directory: "folder", FileType.File: "file"}.get(info.type)
                    rows.append((p, p.rstrip("/") if kind == "folder" else p, kind, info.size if kind == "file" else None, None if kind else "not there"))
                except (OSError, ValueError) as e:
                    rows.append((p, p, None, None, f"not readable: {type(e).__name__}"))
            yield _batch(rows)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is in each folder: its files, and its folders as the next level."""
        for batch in batches:
            for root, folder in zip(batch.column("root").to_pylist(), batch.column("path").to_pylist(), strict=True):
                try:
                    fs, base = file_system(folder)
                    folders, files = entries(folder)
                    sizes = [i.size for i in fs.get_file_info([f"{base}/{f}" for f in files])]
                    rows = [(root, f"{folder}/{f}", "file", n, None) for f, n in zip(files, sizes, strict=True)] + [(root, f"{folder}/{f}", "folder", None, None) for f in folders]
                except OSError as e:
                    rows = [(root, folder, None, None, f"not readable: {type(e).__name__}")]
                yield _batch(rows)

    schema = "root string, path string, kind string, size long, problem string"
    from ..staging import stage

    level = stage(inputs.where(F.col(path).isNotNull()).select(F.col(path).cast("string").alias("path")).distinct().mapInArrow(look, schema), "scan-level")
    found = level.where("kind is null or kind <> 'folder'")
    depth = 0
    while level.where("kind = 'folder'").limit(1).count() and (recursive or depth == 0):
        level = stage(level.where("kind = 'folder'").select("root", "path").repartition("path").mapInArrow(walk, schema), "scan-level")
        found = found.unionByName(level.where("kind is null or kind <> 'folder'"))
        depth += 1
    first = F.min(F.struct("root", "size", "problem"))
    return found.groupBy("path").agg(first.alias("f")).select("f.root", "path", "f.size", "f.problem")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["root", "path", "kind", "size", "problem"])


def _texts(files: DataFrame) -> DataFrame:
    """path, text of small files; null where there is none to be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column("path").to_pylist():
                try:
                    fs, at = file_system(p)
                    with fs.open_input_stream(at) as f:
                        out.append(f.read(LONGEST).decode())
                except (OSError, ValueError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "text"])

    return files.select("path").mapInArrow(run, "path string, text string")


def sidecars_of(files: DataFrame) -> DataFrame:
    """media, sidecar, sidecar_date (seconds), sidecar_lat, sidecar_lon of the files (path, size) that have one beside them.

    Of several candidates in a file's folder the likeliest name counts. A
    sidecar without a date or place, or that is no JSON, has nulls for it; one at
    0, 0 has no place.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    is_json = extension(F.col("path")) == "json"
    media = files.where(~is_json & (media_kind(F.col("path")) != "other")).select(F.col("path").alias("media"), folder("path").alias("folder"), F.posexplode(sidecar_candidates(base_name(F.col("path")))).alias("rank", "name"))
    there = files.where(is_json & (F.col("size") <= LONGEST)).select(F.col("path").alias("sidecar"), folder("path").alias("folder"), base_name(F.col("path")).alias("name"))
    best = media.join(there, ["folder", "name"]).groupBy("media").agg(F.min(F.struct("rank", "sidecar")).alias("b")).select("media", F.col("b.sidecar").alias("sidecar"))
    read = _texts(best.select(F.col("sidecar").alias("path")).distinct())
    place = F.from_json("text", "geoData struct<latitude: double, longitude: double>")["geoData"]
    lat, lon = place["latitude"], place["longitude"]
    placed = in_range(lat, lon) & ~((lat == 0) & (lon == 0))
    facts = read.select(F.col("path").alias("sidecar"), sidecar_date(F.col("text")).alias("sidecar_date"), F.when(placed, lat).alias("sidecar_lat"), F.when(placed, lon).alias("sidecar_lon"))
    return best.join(facts, "sidecar")


def scan(spark: SparkSession, inputs: list[str], recursive: bool = True) -> DataFrame:
    """path, root, kind, size, container, width, height, orientation, camera, offset_minutes, sidecar, taken (timestamp), taken_from, lat, lon, placed_from and problem of all media files.

    A file's own date comes before its sidecar's, and so does its place; taken_from
    and placed_from say which it is. Files of no media kind are left out; what
    cannot be read is a row with a problem.
    """
    files = expand(spark.createDataFrame([(i,) for i in inputs], "path string"), recursive=recursive)
    from ..staging import stage

    files = stage(files, "scan-files")
    media = files.where("problem is not null").unionByName(files.where("problem is null").where((media_kind(F.col("path")) != "other") | extension(F.col("path")).isin("tif", "tiff", "png", "3gp")))
    heads = read_metadata(media.where("problem is null").select("root", "path", "size"))
    own = heads.unionByName(media.where("problem is not null").select("root", "path", "size", "problem"), allowMissingColumns=True)
    beside = sidecars_of(files.where("problem is null"))
    met = own.join(beside, F.col("path") == F.col("media"), "left")
    taken = F.coalesce("capture", F.timestamp_seconds("sidecar_date"))
    taken_from = F.when(F.col("capture").isNotNull(), F.col("capture_tag")).when(F.col("sidecar_date").isNotNull(), "sidecar")
    has = F.col("lat").isNotNull()
    return met.select(
        "path", "root", media_kind(F.col("path")).alias("kind"), "size", F.col("kind").alias("container"), "width", "height", "orientation", "camera", "offset_minutes", "sidecar",
        taken.alias("taken"), taken_from.alias("taken_from"), F.coalesce("lat", "sidecar_lat").alias("lat"), F.coalesce("lon", "sidecar_lon").alias("lon"),
        F.when(has, "file").when(F.col("sidecar_lat").isNotNull(), "sidecar").alias("placed_from"), "problem",
    )
