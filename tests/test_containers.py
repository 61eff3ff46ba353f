"""Pages, heads and previews of small files made here, against what was put into them."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.operators.intervals import nested_intervals
from tidemark.sources import containers as C


def ifd(order, entries, following, at):
    """A directory at `at` with (tag, type, values) entries; longer values follow it."""
    letters = {2: "s", 3: "H", 4: "I", 5: "II"}
    body, extra = struct.pack(order + "H", len(entries)), b""
    after = at + 2 + 12 * len(entries) + 4
    for tag, kind, values in sorted(entries):
        if kind == 2:
            raw, n = values.encode() + b"\0", len(values) + 1
        elif kind == 5:
            raw, n = b"".join(struct.pack(order + "II", a, b) for a, b in values), len(values)
        else:
            raw, n = b"".join(struct.pack(order + letters[kind], v) for v in values), len(values)
        if len(raw) <= 4:
            body += struct.pack(order + "HHI", tag, kind, n) + raw.ljust(4, b"\0")
        else:
            body += struct.pack(order + "HHII", tag, kind, n, after + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return body + struct.pack(order + "I", following) + extra


def tiff(order, pages, last=0):
    """A file of pages (width, height, strips), each a directory and its strips' places; last: where the chain goes on."""
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    for k, (w, h, strips) in enumerate(pages):
        entries = [(0x100, 3, [w]), (0x101, 4, [h]), (0x111, 4, [1000 + 10 * k + i for i in range(strips)]), (0x117, 3, [7 + i for i in range(strips)])]
        size = len(ifd(order, entries, 0, len(out)))
        out += ifd(order, entries, len(out) + size if k + 1 < len(pages) else last, len(out))
    return out


def write(folder, name, body):
    (folder / name).write_bytes(body)
    return str(folder / name)


def test_pages(spark, tmp_path):
    rng = random.Random(1)
    shapes = {f"{k}.tif": [(rng.randrange(1, 60000), rng.randrange(1, 90000), rng.choice([1, 2, 40])) for _ in range(rng.choice([1, 2, 9]))] for k in range(12)}
    paths = {write(tmp_path, n, tiff("<>"[i % 2], p)): p for i, (n, p) in enumerate(shapes.items())}
    one = tiff("<", [(10, 20, 1), (30, 40, 1)])
    bad = {
        write(tmp_path, "loop.tif", tiff("<", [(10, 20, 1), (30, 40, 1)], last=8)): "the chain loops",
        write(tmp_path, "short.tif", one[:-12]): "cut short",
        write(tmp_path, "far.tif", tiff("<", [(10, 20, 1)], last=10**6)): "cut short",
        write(tmp_path, "none.tif", b"II" + struct.pack("<HI", 42, 0)): "no pages",
        write(tmp_path, "text.tif", b"hello there"): "no directory",
        write(tmp_path, "empty.tif", b""): "cut short",
        str(tmp_path / "missing.tif"): "not readable: FileNotFoundError",
    }
    files = spark.createDataFrame([(p, 1) for p in [*paths, *bad]] + [(None, 1)], "path string, width int")
    got = {}
    for r in C.pages(files).collect():
        got.setdefault(r.path, []).append(r)
    assert set(got) == {*paths, *bad}
    for path, shape in paths.items():
        found = sorted(got[path], key=lambda r: r.page)
        assert [(r.page, r.width, r.height, r.offset, r.bytes, r.reason) for r in found] == [(k, w, h, 1000 + 10 * k, sum(7 + i for i in range(n)), None) for k, (w, h, n) in enumerate(shape)]
    for path, reason in bad.items():
        assert [r.reason for r in sorted(got[path], key=lambda r: r.page)][-1] == reason
    assert [r.page for r in sorted(got[str(tmp_path / "loop.tif")], key=lambda r: r.page)] == [0, 1, 2]


def test_pages_in_sql(spark, tmp_path):
    path = write(tmp_path, "a.tif", tiff(">", [(3, 4, 1)] * 3))
    spark.udtf.register("tiff_pages", C.TiffPages)
    spark.createDataFrame([(path,)], "path string").createOrReplaceTempView("tiff_files")
    assert [r.page for r in spark.sql("SELECT p.page FROM tiff_files, LATERAL tiff_pages(path) p ORDER BY 1").collect()] == [0, 1, 2]


def test_wide_directories():
    entries = [(0x100, 3, 17), (0x101, 4, 18)]
    body = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", 2) + b"".join(struct.pack("<HHQQ", t, k, 1, v) for t, k, v in entries) + struct.pack("<Q", 0)
    assert [r[:3] for r in C.pages_of(in_memory(body))] == [(0, 17, 18)]


def in_memory(body):
    import io

    return C.Ranged(io.BytesIO(body), len(body))


def exif(order="<", base=8):
    """A directory with camera, dates and place, and the directories that it points to."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    place = [(1, 2, "S"), (2, 5, [(10, 1), (30, 1), (36, 1)]), (3, 2, "E"), (4, 5, [(20, 1), (15, 1), (0, 1)]), (5, 1 + 2, [1]), (6, 5, [(1234, 10)])]
    detail = [(0x9003, 2, "2024:05:06 07:08:09"), (0x9004, 2, "2023:01:01 00:00:00"), (0x9011, 2, "+02:30"), (0x9010, 2, "-01:00"), (0xA002, 4, [6000]), (0xA003, 3, [4000])]
    main = lambda d, p: [(0x110, 2, "Camera X"), (0x112, 3, [6]), (0x132, 2, "2022:02:02 02:02:02"), (0x100, 3, [160]), (0x101, 3, [120]), (0x8769, 4, [d]), (0x8825, 4, [p])]
    size = len(ifd(order, main(0, 0), 0, base))
    d = base + size
    p = d + len(ifd(order, detail, 0, d))
    return head + ifd(order, main(d, p), 0, base) + ifd(order, detail, 0, d) + ifd(order, place, 0, p)


FACTS = {"camera": "Camera X", "orientation": 6, "lat": -10.51, "lon": 20.25, "altitude": -123.4, "capture": "2024-05-06 07:08:09", "capture_tag": "original", "offset_minutes": 150, "problem": None}


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(inner=b"", size=(11, 12)):
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9) + inner + segment(0xC0, struct.pack(">BHH", 8, size[1], size[0]) + b"\0" * 10) + segment(0xDA, b"\0" * 10) + b"scan" + b"\xff\xd9"


def box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, name) + body


def full(name, *parts, version=0):
    return box(name, bytes([version, 0, 0, 0]), *parts)


def quicktime():
    made = C.FROM_1904 + 1_700_000_000
    moved = full(b"mvhd", struct.pack(">IIII", made, made, 600, 6000), b"\0" * 80)
    track = lambda w, h: box(b"trak", full(b"tkhd", b"\0" * 72, struct.pack(">II", w << 16, h << 16)))
    names = [b"com.apple.quicktime.location.ISO6709", b"com.apple.quicktime.creationdate"]
    keys = full(b"keys", struct.pack(">I", 2), *(struct.pack(">I", len(k) + 8) + b"mdta" + k for k in names))
    value = lambda k, v: box(struct.pack(">I", k), box(b"data", struct.pack(">II", 1, 0), v))
    meta = box(b"meta", full(b"hdlr", b"\0" * 20), keys, box(b"ilst", value(1, b"+52.5000-013.2500+034.500/"), value(2, b"2023-11-14T23:13:20+0100")))
    return box(b"ftyp", b"qt  ", b"\0" * 4), box(b"moov", moved, track(0, 0), track(1920, 1080), meta)


def heic():
    start = 2000
    body = exif(">")
    item = full(b"infe", struct.pack(">HH", 7, 0), b"Exif", b"\0", version=2)
    info = full(b"iinf", struct.pack(">H", 1), item)
    place = full(b"iloc", bytes([0x44, 0]), struct.pack(">H", 1), struct.pack(">HHHII", 7, 0, 1, start, len(body) + 10))
    props = box(b"iprp", box(b"ipco", full(b"ispe", struct.pack(">II", 160, 120)), full(b"ispe", struct.pack(">II", 4032, 3024)), box(b"irot", b"\x03")))
    meta = full(b"meta", full(b"hdlr", b"\0" * 20), info, place, props)
    front = box(b"ftyp", b"heic", b"\0" * 4) + meta
    return front + box(b"mdat", b"\0" * (start - len(front) - 8), struct.pack(">I", 6), b"Exif\0\0", body)


def facts(row, names):
    out = {n: row[n] for n in names}
    if out.get("capture"):
        out["capture"] = str(out["capture"])
    return {k: round(v, 6) if isinstance(v, float) else v for k, v in out.items()}


def test_metadata_by_kind(spark, tmp_path):
    front, moov = quicktime()
    raf = bytearray(b"FUJIFILMCCD-RAW " + b"\0" * 200)
    raf[84:88] = struct.pack(">I", len(raf))
    inside = segment(0xE1, b"Exif\0\0" + exif())
    video = {"kind": "quicktime", "width": 1920, "height": 1080, "lat": 52.5, "lon": -13.25, "altitude": 34.5, "capture": "2023-11-14 23:13:20", "capture_tag": "created_local", "offset_minutes": 60, "problem": None}
    want = {
        write(tmp_path, "a.jpg", jpeg(inside)): FACTS | {"kind": "jpeg", "width": 11, "height": 12},
        write(tmp_path, "b.tif", exif(">")): FACTS | {"kind": "tiff", "width": 6000, "height": 4000},
        write(tmp_path, "c.cr2", exif("<")): FACTS | {"kind": "tiff", "width": 6000, "height": 4000},
        write(tmp_path, "d.raf", bytes(raf) + jpeg(inside)): FACTS | {"kind": "raf", "width": 11, "height": 12},
        write(tmp_path, "e.heic", heic()): FACTS | {"kind": "heif", "width": 4032, "height": 3024},
        write(tmp_path, "f.mov", front + moov): video,
        write(tmp_path, "g.mov", front + box(b"mdat", b"\0" * 5000) + moov): video,
        write(tmp_path, "h.jpg", b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + exif())[:60]): {"kind": "jpeg", "problem": "cut short"},
        write(tmp_path, "i.bin", b"something else"): {"kind": None, "problem": "unknown kind"},
        write(tmp_path, "j.mov", front + struct.pack(">I4s", 10**6, b"moov")): {"kind": "quicktime", "problem": "a box that is longer than what holds it"},
        write(tmp_path, "k.jpg", b""): {"problem": "unknown kind"},
        str(tmp_path / "none"): {"problem": "not readable: FileNotFoundError"},
    }
    files = spark.createDataFrame([(p, "x") for p in want] + [(None, "x")], "path string, kind string")
    got = {r.path: r for r in C.read_metadata(files).collect()}
    assert set(got) == {*want, None}
    for path, expected in want.items():
        assert facts(got[path], expected) == expected, path


@pytest.mark.parametrize("kind", ["mov", "jpg", "tif"])
def test_a_large_file_costs_kilobytes(spark, tmp_path, kind):
    front, moov = quicktime()
    path = tmp_path / f"large.{kind}"
    with open(path, "wb") as f:  # sparse: 10 GB without its bytes
        if kind == "mov":
            f.write(front + struct.pack(">I4sQ", 1, b"mdat", 10 << 30))
            f.seek(len(front) + (10 << 30))
            f.write(moov)
        else:
            f.write(exif() if kind == "tif" else jpeg(segment(0xE1, b"Exif\0\0" + exif())))
            f.truncate(10 << 30)
    r = C.read_metadata(spark.createDataFrame([(str(path),)], "path string")).first()
    assert r.problem is None and r.capture is not None and r.fetched <= 16 << 10


def by_stack(body):
    """(level, offset, bytes) of marked pictures, by a stack over the whole file."""
    out, stack = [], []
    for i in range(len(body) - 1):
        if body[i : i + 3] in (b"\xff\xd8\xff",) or body[i : i + 2] == b"\xff\xd8" and body[i + 2 : i + 3] == b"\xff":
            stack.append(i)
        elif body[i : i + 2] == b"\xff\xd9" and stack:
            start = stack.pop()
            out.append((len(stack) + 1, start, i + 2 - start))
    return sorted(out)


def test_previews_for_every_chunk_size(spark, tmp_path):
    rng = random.Random(3)
    noise = lambda n: bytes(rng.choice([0, 1, 0xFF, 0xD8, 0xD9]) for _ in range(n))
    bodies = {"raw": b"head" + jpeg(segment(0xE1, jpeg())) + b"x" * 50 + jpeg(b"") + b"tail", "noise": noise(600), "jpg": jpeg(segment(0xE1, b"Exif" + jpeg(size=(1, 2)))), "none": b"nothing", "open": b"\xff\xd9\xff\xd8\xff" + jpeg()}
    files = spark.createDataFrame([(write(tmp_path, n, b), len(b)) for n, b in bodies.items()] + [(None, 5)], "path string, size long")
    want = sorted((str(tmp_path / n), *x) for n, b in bodies.items() for x in by_stack(b))
    for chunk in (1, 2, 3, 7, 64, 1 << 20):
        assert sorted(tuple(r) for r in C.previews(files, chunk).collect()) == want, chunk
    largest = {r.path: (r.offset, r.bytes) for r in C.largest_preview(files, 16).collect()}
    for n, b in bodies.items():
        inside = [(o, s) for _, o, s in by_stack(b) if o]
        assert largest.get(str(tmp_path / n)) == (max(inside, key=lambda x: (x[1], -x[0])) if inside else None)


def test_nested_intervals_equal_a_stack(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.random() < 0.5) for k in "abc" for i in range(200)]
    want = []
    for k in "abc":
        stack = []
        for _, i, opens in (r for r in rows if r[0] == k):
            if opens:
                stack.append(i)
            elif stack:
                start = stack.pop()
                want.append((k, len(stack) + 1, start, i))
    df = spark.createDataFrame(rows + [("a", None, True), (None, 5, False)], "k string, at long, o boolean").orderBy(F.rand(1))
    assert sorted(tuple(r) for r in nested_intervals(df, "k", "at", "o").collect()) == sorted(want)
