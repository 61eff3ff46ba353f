"""Pages, dates, sizes and places from the heads of media files, read by ranges.

A file is opened and only the blocks that its directory chain or box tree points
to are read, so a file of 10 GB costs kilobytes. Files come as rows (path), tasks
open them; a path is anything that pyarrow's file systems read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions.dates import best_date, utc_offset_minutes
from ..session import ship
from .media import file_system

BLOCK = 4096
#: A directory with more entries, or a chain with more pages, is taken as broken.
MOST_ENTRIES, MOST_PAGES = 4096, 1 << 20


class Broken(ValueError):
    """A file that does not go on as it says; its text is the reason."""


class Ranged:
    """Reads of an open file by offset, in blocks that are kept; `fetched` counts the bytes that were read."""

    def __init__(self, file, size: int):
        self.file, self.size, self.blocks, self.fetched = file, size, {}, 0

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise Broken("cut short")
        out = bytearray()
        while n > 0:
            k, skip = divmod(at, BLOCK)
            if k not in self.blocks:
                if len(self.blocks) >= 256:
                    self.blocks.clear()
                self.file.seek(k * BLOCK)
                self.blocks[k] = self.file.read(min(BLOCK, self.size - k * BLOCK))
                self.fetched += len(self.blocks[k])
            piece = self.blocks[k][skip : skip + n]
            if not piece:
                raise Broken("cut short")
            out += piece
            at, n = at + len(piece), n - len(piece)
        return bytes(out)

    def unpack(self, form: str, at: int) -> tuple:
        return struct.unpack(form, self.read(at, struct.calcsize(form)))


def opened(path: str) -> tuple[object, Ranged]:
    fs, at = file_system(path)
    f = fs.open_input_file(at)
    return f, Ranged(f, f.size())


# --- directories (TIFF and what is built on it) -------------------------------------------------------------------------

#: Bytes of a value by its type, and struct letters of the whole-number types.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Tags that are read.
WIDTH, HEIGHT, MODEL, STRIPS, ORIENTATION, STRIP_BYTES, MODIFIED, TILES, TILE_BYTES = 0x100, 0x101, 0x110, 0x111, 0x112, 0x117, 0x132, 0x144, 0x145
SUB, DETAIL, PLACE, JPEG_AT, JPEG_BYTES = 0x14A, 0x8769, 0x8825, 0x201, 0x202
ORIGINAL, DIGITISED, OFFSET, OFFSET_ORIGINAL, OFFSET_DIGITISED, SEEN_WIDTH, SEEN_HEIGHT = 0x9003, 0x9004, 0x9010, 0x9011, 0x9012, 0xA002, 0xA003


class Directories:
    """A directory chain from `base` on: 32-bit files and those with 64-bit offsets, in either byte order."""

    def __init__(self, source: Ranged, base: int = 0):
        self.source, self.base = source, base
        order = source.read(base, 2)
        if order not in (b"II", b"MM"):
            raise Broken("no directory")
        self.order = "<" if order == b"II" else ">"
        (magic,) = source.unpack(self.order + "H", base + 2)
        self.wide = magic == 43
        if magic not in (42, 43, 0x55, 0x4F52, 0x5352):  # the last three: camera files of the same make
            raise Broken("no directory")
        (self.first,) = source.unpack(self.order + ("Q" if self.wide else "I"), base + (8 if self.wide else 4))

    def directory(self, at: int) -> tuple[dict[int, tuple[int, int, int]], int]:
        """Entries by tag (type, count, place of the value), and the next directory."""
        at += self.base
        head, entry = ("Q", 20) if self.wide else ("H", 12)
        (n,) = self.source.unpack(self.order + head, at)
        if n == 0 or n > MOST_ENTRIES:
            raise Broken("a directory with an impossible number of entries")
        start = at + struct.calcsize(self.order + head)
        out = {}
        for k in range(n):
            tag, kind, count = self.source.unpack(self.order + ("HHQ" if self.wide else "HHI"), start + k * entry)
            field = start + k * entry + (12 if self.wide else 8)
            if SIZES.get(kind, 1) * count > (8 if self.wide else 4):
                field = self.base + self.source.unpack(self.order + ("Q" if self.wide else "I"), field)[0]
            out[tag] = (kind, count, field)
        (following,) = self.source.unpack(self.order + ("Q" if self.wide else "I"), start + n * entry)
        return out, following

    def numbers(self, entry: tuple[int, int, int] | None, most: int = 1 << 16) -> list[int]:
        if entry is None or entry[0] not in LETTERS:
            return []
        kind, count, field = entry
        return list(self.source.unpack(f"{self.order}{min(count, most)}{LETTERS[kind]}", field))

    def text(self, entry: tuple[int, int, int] | None) -> str | None:
        if entry is None or entry[0] != 2:
            return None
        return self.source.read(entry[2], min(entry[1], 1024)).split(b"\0")[0].decode("latin-1").strip()

    def rationals(self, entry: tuple[int, int, int] | None) -> list[float]:
        if entry is None or entry[0] != 5:
            return []
        parts = self.source.unpack(f"{self.order}{2 * min(entry[1], 16)}I", entry[2])
        return [a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2], strict=True)]

    def total(self, entry: tuple[int, int, int] | None) -> int:
        """The sum of a list of numbers, read in pieces."""
        if entry is None or entry[0] not in LETTERS:
            return 0
        kind, count, field = entry
        out, size = 0, SIZES[kind]
        for i in range(0, count, 1024):
            n = min(1024, count - i)
            out += sum(self.source.unpack(f"{self.order}{n}{LETTERS[kind]}", field + i * size))
        return out


PAGE_SCHEMA = "page int, width long, height long, offset long, bytes long, reason string"


def pages_of(source: Ranged) -> Iterator[tuple]:
    """(page, width, height, offset, bytes, reason) along the chain; a chain that loops or breaks off ends with a row that has its reason."""
    page, seen = 0, set()
    try:
        walk = Directories(source)
        at = walk.first
        while at:
            if at in seen:
                raise Broken("the chain loops")
            if page >= MOST_PAGES:
                raise Broken("the chain does not end")
            seen.add(at)
            entries, following = walk.directory(at)
            width, height = (walk.numbers(entries.get(t))[:1] for t in (WIDTH, HEIGHT))
            if not width or not height:
                raise Broken("a page without a size")
            offsets = entries.get(STRIPS) or entries.get(TILES)
            start = walk.numbers(offsets, 1)[:1] if offsets else []
            total = walk.total(entries.get(STRIP_BYTES) or entries.get(TILE_BYTES))
            yield (page, width[0], height[0], start[0] if start else None, total, None)
            page, at = page + 1, following
        if page == 0:
            raise Broken("no pages")
    except (Broken, struct.error) as e:
        yield (page, None, None, None, None, str(e))


@udtf(returnType=PAGE_SCHEMA)
class TiffPages:
    """Table function tiff_pages(path): a row for each page of a file, without its pixels."""

    def eval(self, path: str):
        if path is None:
            return
        try:
            f, source = opened(path)
        except (OSError, ValueError) as e:
            yield (0, None, None, None, None, f"not readable: {type(e).__name__}")
            return
        with f:
            yield from pages_of(source)


def pages(files: DataFrame, path: str = "path") -> DataFrame:
    """The columns of files with page, width, height, offset, bytes and reason of each page, by a lateral join with tiff_pages.

    A file that cannot be read or is no such file is one row with a reason; a null path gives none.
    """
    spark = files.sparkSession
    ship(spark)
    spark.udtf.register("tiff_pages", TiffPages)
    clash = set(files.columns) & {"page", "width", "height", "offset", "bytes", "reason"}
    return files.drop(*clash).alias("f").lateralJoin(TiffPages(F.col(f"f.{path}").outer()))


# --- metadata by kind ------------------------------------------------------------------------------------------------------


def _degrees(walk: Directories, entries: dict, value: int, sign: int, negative: str) -> float | None:
    parts = (walk.rationals(entries.get(value)) + [0.0, 0.0])[:3] if entries.get(value) else []
    if len(parts) < 3:
        return None
    out = parts[0] + parts[1] / 60 + parts[2] / 3600
    return -out if (walk.text(entries.get(sign)) or "").upper().startswith(negative) else out


def _from_directories(walk: Directories, out: dict) -> None:
    entries, _ = walk.directory(walk.first)
    for tag, name in ((MODEL, "model"), (MODIFIED, "modified")):
        out.setdefault(name, walk.text(entries.get(tag)))
    for tag, name in ((ORIENTATION, "orientation"), (WIDTH, "width"), (HEIGHT, "height")):
        if found := walk.numbers(entries.get(tag), 1):
            out.setdefault(name, found[0])
    if at := walk.numbers(entries.get(DETAIL), 1):
        detail, _ = walk.directory(at[0])
        for tag, name in ((ORIGINAL, "original"), (DIGITISED, "digitised"), (OFFSET_ORIGINAL, "offset_original"), (OFFSET_DIGITISED, "offset_digitised"), (OFFSET, "offset")):
            out[name] = walk.text(detail.get(tag))
        for tag, name in ((SEEN_WIDTH, "width"), (SEEN_HEIGHT, "height")):
            if (found := walk.numbers(detail.get(tag), 1)) and found[0]:
                out[name] = found[0]
    if at := walk.numbers(entries.get(PLACE), 1):
        place, _ = walk.directory(at[0])
        lat, lon = _degrees(walk, place, 2, 1, "S"), _degrees(walk, place, 4, 3, "W")
        if lat is not None and lon is not None:
            out["lat"], out["lon"] = lat, lon
            if height := walk.rationals(place.get(6)):
                out["altitude"] = -height[0] if walk.numbers(place.get(5), 1) == [1] else height[0]


def _from_jpeg(source: Ranged, out: dict) -> None:
    at = 2
    while at + 4 <= source.size:
        mark, marker = source.read(at, 2)
        if mark != 0xFF:
            raise Broken("no marker where one should be")
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker in (0xD9, 0xDA):
            return
        (size,) = source.unpack(">H", at + 2)
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = source.unpack(">HH", at + 5)
        elif marker == 0xE1 and size >= 16 and source.read(at + 4, 6) == b"Exif\0\0":
            _from_directories(Directories(source, at + 10), seen := {})
            out |= {k: v for k, v in seen.items() if k not in ("width", "height") or k not in out}
        at += 2 + size


#: Fixed value: seconds from 1904 to 1970, from when QuickTime counts.
FROM_1904 = 2_082_844_800
#: Boxes that hold boxes.
HOLDERS = {b"moov", b"trak", b"mdia", b"udta", b"meta", b"iprp", b"ipco"}


def boxes(source: Ranged, at: int, end: int, depth: int = 0) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of names, start and end of the content) of boxes, those within others too."""
    for _ in range(1 << 16):
        if at + 8 > end:
            return
        size, name = source.unpack(">I4s", at)
        head = 8
        if size == 1:
            (size,), head = source.unpack(">Q", at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Broken("a box that is longer than what holds it")
        start, stop = at + head, at + size
        yield (name,), start, stop
        if name in HOLDERS and depth < 8:
            inner = start
            if name == b"meta" and stop - start >= 8 and source.read(start + 4, 4) != b"hdlr":
                inner = start + 4  # with a version, as HEIC has it
            yield from (((name, *path), a, b) for path, a, b in boxes(source, inner, stop, depth + 1))
        at += size


_POSITION = re.compile(r"([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?")


def _position(text: str, out: dict) -> None:
    if m := _POSITION.match(text):
        out["lat"], out["lon"] = float(m[1]), float(m[2])
        if m[3]:
            out["altitude"] = float(m[3])


def _from_boxes(source: Ranged, out: dict) -> None:
    """Dates, size and place of QuickTime and HEIC files: the largest track or image is the size."""
    keys: list[str] = []
    extents: dict[int, tuple[int, int]] = {}
    exif: list[int] = []
    best = 0
    for path, a, b in boxes(source, 0, source.size):
        name = path[-1]
        if name == b"mvhd":
            (version,) = source.unpack(">B", a)
            (made,) = source.unpack(">Q" if version else ">I", a + 4)
            if made:
                out["created_utc"] = made - FROM_1904
        elif name == b"tkhd":
            w, h = (x >> 16 for x in source.unpack(">II", b - 8))
            if w * h > best:
                best, out["width"], out["height"] = w * h, w, h
        elif name == b"ispe":
            w, h = source.unpack(">II", a + 4)
            if w * h > best:
                best, out["width"], out["height"] = w * h, w, h
        elif name == b"irot":
            out["orientation"] = {0: 1, 1: 8, 2: 3, 3: 6}[source.unpack(">B", a)[0] & 3]
        elif name == b"\xa9xyz" and b - a >= 4:
            (n,) = source.unpack(">H", a)
            _position(source.read(a + 4, min(n, b - a - 4)).decode("latin-1"), out)
        elif name == b"keys":
            at = a + 8
            for _ in range(min(source.unpack(">I", a + 4)[0], 1024)):
                (size,) = source.unpack(">I", at)
                keys.append(source.read(at + 8, max(0, size - 8)).decode("latin-1"))
                at += max(size, 8)
        elif name == b"ilst":
            for (item, *_), start, stop in boxes(source, a, b):
                k = int.from_bytes(item, "big")
                value = source.read(start + 16, min(stop - start - 16, 1024)).decode("utf-8", "replace") if stop - start >= 16 else ""
                if 0 < k <= len(keys) and keys[k - 1] == "com.apple.quicktime.creationdate":
                    out["created_local"] = value
                elif 0 < k <= len(keys) and keys[k - 1] == "com.apple.quicktime.location.ISO6709":
                    _position(value, out)
        elif name == b"iinf":
            (version,) = source.unpack(">B", a)
            for (entry, *_), start, _stop in boxes(source, a + (8 if version else 6), b):
                if entry == b"infe" and source.read(start + 8, 4) == b"Exif":
                    exif.append(source.unpack(">H", start + 4)[0])
        elif name == b"iloc":
            extents |= _item_extents(source, a)
    for item in exif:
        if item in extents:
            start, size = extents[item]
            (skip,) = source.unpack(">I", start)
            own: dict = {}
            _from_directories(Directories(source, start + 4 + skip), own)
            out |= {k: v for k, v in own.items() if k not in ("width", "height", "orientation") or k not in out}


def _item_extents(source: Ranged, a: int) -> dict[int, tuple[int, int]]:
    """Start and bytes of the first extent of each item."""
    version, sizes, more = source.unpack(">B3xBB", a)
    n_offset, n_length, n_base, n_index = sizes >> 4, sizes & 15, more >> 4, more & 15 if version else 0
    number = lambda at, n: int.from_bytes(source.read(at, n), "big") if n else 0
    (count,), at = source.unpack(">I" if version == 2 else ">H", a + 6), a + (10 if version == 2 else 8)
    out = {}
    for _ in range(min(count, 1 << 16)):
        item = number(at, 4 if version == 2 else 2)
        at += (4 if version == 2 else 2) + (2 if version else 0) + 2
        base = number(at, n_base)
        (extents,) = source.unpack(">H", at + n_base)
        at += n_base + 2
        for k in range(extents):
            start, size = number(at + n_index, n_offset), number(at + n_index + n_offset, n_length)
            if k == 0:
                out[item] = (base + start, size)
            at += n_index + n_offset + n_length
    return out


def read_head(source: Ranged) -> dict:
    """kind, facts and problem of a file, by its first bytes."""
    out: dict = {}
    try:
        head = source.read(0, min(16, source.size))
        if head[:2] == b"\xff\xd8":
            out["kind"] = "jpeg"
            _from_jpeg(source, out)
        elif head[:2] in (b"II", b"MM"):
            out["kind"] = "tiff"
            _from_directories(Directories(source), out)
        elif head[:15] == b"FUJIFILMCCD-RAW":
            out["kind"] = "raf"
            (at,) = source.unpack(">I", 84)
            _from_jpeg(_Part(source, at), out)
        elif head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"):
            out["kind"] = "heif" if head[8:12] in (b"heic", b"heix", b"mif1", b"msf1", b"avif") else "quicktime"
            _from_boxes(source, out)
        else:
            out["problem"] = "unknown kind"
    except (Broken, struct.error, OSError, KeyError) as e:
        out["problem"] = str(e) or type(e).__name__
    return out


class _Part:
    """A file within a file."""

    def __init__(self, source: Ranged, base: int):
        self.source, self.base, self.size = source, base, source.size - base

    def read(self, at: int, n: int) -> bytes:
        return self.source.read(self.base + at, n)

    def unpack(self, form: str, at: int) -> tuple:
        return self.source.unpack(form, self.base + at)


TEXTS = ("kind", "model", "modified", "original", "digitised", "offset", "offset_original", "offset_digitised", "created_local", "problem")
WHOLE = ("width", "height", "orientation", "created_utc", "fetched")
REAL = ("lat", "lon", "altitude")


def read_metadata(files: DataFrame, path: str = "path") -> DataFrame:
    """The columns of files with kind, width, height, orientation, camera, lat, lon, altitude, capture, capture_tag, offset_minutes, fetched, problem.

    capture is the best date that the file has, in the file's own zone but for
    QuickTime's `created`, which is in UTC. fetched is how many bytes were read.
    A file that cannot be read, is cut short or is of no known kind has a
    problem and what was found before. Null paths give nulls; columns of files
    that have a result's name give way to it.
    """
    ship(files.sparkSession)
    results = {"kind", "width", "height", "orientation", "camera", "lat", "lon", "altitude", "capture", "capture_tag", "offset_minutes", "fetched", "problem"}
    keep = [c for c in files.columns if c not in results]
    rows = files.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.col(path).cast("string").alias("__path"))
    names = [*(f"__k{i}" for i in range(len(keep))), *TEXTS, *WHOLE, *REAL]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p in batch.column("__path").to_pylist():
                head: dict = {}
                if p is not None:
                    try:
                        f, source = opened(p)
                        with f:
                            head = read_head(source) | {"fetched": source.fetched}
                    except (OSError, ValueError) as e:
                        head = {"problem": f"not readable: {type(e).__name__}"}
                found.append(head)
            columns = [pa.array([h.get(c) for h in found], kind) for group, kind in ((TEXTS, pa.string()), (WHOLE, pa.int64()), (REAL, pa.float64())) for c in group]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    kinds = [T.StringType()] * len(TEXTS) + [T.LongType()] * len(WHOLE) + [T.DoubleType()] * len(REAL)
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, k) for c, k in zip(names[len(keep) :], kinds, strict=True))])
    read = rows.mapInArrow(run, schema)
    best = best_date({c: F.col(c) for c in ("original", "digitised", "modified")})
    local = F.try_to_timestamp(F.regexp_replace(F.substring("created_local", 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    created = F.timestamp_seconds("created_utc")
    capture = F.coalesce(best["value"].cast("timestamp"), local, created)
    tag = F.coalesce(best["tag"], F.when(local.isNotNull(), "created_local"), F.when(created.isNotNull(), "created_utc"))
    zone = F.regexp_replace(F.regexp_extract("created_local", r"([+-]\d{2}:?\d{2}|Z)$", 1), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    offset = F.coalesce(utc_offset_minutes(F.coalesce("offset_original", "offset_digitised", "offset")), utc_offset_minutes(F.when(zone != "", zone)))
    own = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    return read.select(*own, "kind", "width", "height", "orientation", F.col("model").alias("camera"), *REAL, capture.alias("capture"), tag.alias("capture_tag"), offset.alias("offset_minutes"), "fetched", "problem")


# --- previews inside files ----------------------------------------------------------------------------------------------------


def previews(files: DataFrame, chunk: int = 64 << 20) -> DataFrame:
    """path, level, offset, bytes of every picture in files (path, size) that a start and an end marker enclose.

    A file is scanned in chunks by as many tasks, each with the two bytes that
    follow; markers are paired as brackets are, so a picture within a picture has
    a higher level (1: in nothing). An end without a start, or the reverse, gives
    nothing. Null paths and sizes give none.
    """
    from ..operators.intervals import nested_intervals

    ship(files.sparkSession)
    known = files.where("path is not null and size > 0").select("path", "size")
    parts = known.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long"))).alias("start"))
    dealt = parts.repartition("path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                fs, at = file_system(path)
                with fs.open_input_file(at) as f:
                    f.seek(start)
                    body = f.read(min(chunk + 2, size - start))
                found = [(m.start() + start, m.group() != b"\xff\xd9") for m in re.finditer(rb"\xff\xd8(?=\xff)|\xff\xd9", body) if m.start() < chunk]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([p for p, _ in found], pa.int64()), pa.array([o for _, o in found], pa.bool_())], names=["path", "at", "opens"])

    marks = dealt.mapInArrow(run, "path string, at long, opens boolean")
    found = nested_intervals(marks, "path", "at", "opens")
    return found.select("path", "level", F.col("start").alias("offset"), (F.col("end") + 2 - F.col("start")).alias("bytes"))


def largest_preview(files: DataFrame, chunk: int = 64 << 20) -> DataFrame:
    """path, offset, bytes of each file's largest picture that does not begin the file; of equal ones the first."""
    inside = previews(files, chunk).where("offset > 0")
    best = F.max(F.struct("bytes", (-F.col("offset")).alias("back")))
    return inside.groupBy("path").agg(best.alias("b")).select("path", (-F.col("b.back")).alias("offset"), "b.bytes")
