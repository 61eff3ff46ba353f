import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans.plan import Plan, Snapshots, first_reason
from tidemark.sources import media, tables, tracks

GPX = """<?xml version="1.0"?><gpx xmlns="urn:any"><wpt lat="1" lon="2"><time>2024-01-01T00:00:00Z</time></wpt><trk><trkseg>
<trkpt lat="3" lon="4"><ele>0.00</ele><time>2024-01-01T00:00:10Z</time></trkpt>
<trkpt lat="5" lon="6"><time>2024-01-01T00:00:10Z</time></trkpt>
<trkpt lat="95" lon="6"><time>2024-01-01T00:00:20Z</time></trkpt><trkpt lat="1" lon="1"/></trkseg></trk></gpx>"""


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    (tmp_path / "b.gpx").write_text("not xml")
    rows = tracks.read_gpx(spark, str(tmp_path)).collect()
    good = sorted((r["at"], r["lat"], r["ele"]) for r in rows if r["reason"] is None)
    assert good == [(1_704_067_200, 1.0, None), (1_704_067_210, 3.0, 0.0)]
    assert sorted(r["reason"].split(":")[0] for r in rows if r["reason"]) == ["no position in range", "no time", "not a document"]


def test_gpx_is_written_the_same_in_any_order(spark):
    points = spark.createDataFrame([("t", 10, 1.0, 2.0, None), ("t", 5, 3.0, 4.0, 7.25)], "k string, at long, lat double, lon double, ele double")
    a, b = (tracks.write_gpx(p, "k").first() for p in (points, points.orderBy("at")))
    assert a["track_id"] == b["track_id"] and '<trkpt lat="3.0000000" lon="4.0000000"><ele>7.25</ele>' in a["gpx"]


def test_timeline(spark, tmp_path):
    doc = [
        {"startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-01T01:00:00Z", "visit": {"topCandidate": {"placeLocation": "geo:1.5,2.5"}}},
        {"startTime": "2024-01-01T02:00:00Z", "endTime": "2024-01-01T03:00:00Z", "timelinePath": [{"point": "geo:3,4", "durationMinutesOffsetFromStartTime": "5"}, {"point": "geo:99,4", "durationMinutesOffsetFromStartTime": "6"}]},
        {"startTime": "2024-01-01T04:00:00Z", "endTime": "2024-01-01T05:00:00Z", "activity": {}},
    ]
    (tmp_path / "t.json").write_text(json.dumps(doc))
    rows = tracks.read_timeline(spark, str(tmp_path)).collect()
    assert sorted((r["at"] - 1_704_067_200, r["lat"]) for r in rows if r["reason"] is None) == [(0, 1.5), (3600, 1.5), (7500, 3.0)]
    assert [r["reason"] for r in rows if r["reason"]] == ["no position in range"]


def test_reports(spark):
    lines = ['{"_type":"location","tst":5,"lat":1,"lon":2,"tid":"x"}', '[{"_type":"location","tst":6,"lat":1,"lon":2},{"_type":"lwt"}]', "junk", '{"_type":"location","lat":1,"lon":2}']
    got = tracks.route_reports(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {r["route"]: r["count"] for r in got.groupBy("route").count().collect()} == {"fix": 2, "ignored": 1, "refused": 2}


def test_media_folder(spark, tmp_path):
    for name in ("DCIM/_DSC1.JPG", "DCIM/a/b/IMG_2.cr2", ".hidden/x.jpg", "MISC/y.jpg", "DCIM/a/Private/z.jpg", "DCIM/.DS_Store"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    assets, problems = media.scan_folder(spark, str(tmp_path))
    assert {(r["rel_path"], r["kind"], r["bytes"]) for r in assets.collect()} == {("DCIM/_DSC1.JPG", "jpeg", 14), ("DCIM/a/b/IMG_2.cr2", "raw", 18)}
    assert problems.count() == 0
    assert media.accept(assets, ["jpg"]).where("reason is null").count() == 1


def cube(size=3):
    axis = np.linspace(0, 1, size)
    rows = [f"{r:.6f} {g:.6f} {b * b:.6f}" for b in axis for g in axis for r in axis]
    return f"TITLE x\nLUT_3D_SIZE {size}\n" + "\n".join(rows)


def test_lattices(spark, tmp_path):
    (tmp_path / "a.cube").write_text(cube())
    (tmp_path / "b.cube").write_text("LUT_3D_SIZE 3\n0 0 0")
    rows = tables.read_lattices(spark, str(tmp_path))
    assert rows.where("problem is null").count() == 27 and rows.where("problem is not null").count() == 1
    size, values = tables.parse_cube(cube())
    assert size == 3 and np.allclose(values[2, 1, 1], [1, 0.5, 0.25])
    look = tables.apply_lattice(spark, values)
    r = spark.range(1).select(look(F.lit(0.25), F.lit(0.5), F.lit(1.0)).alias("x")).first()["x"]
    assert np.allclose([r["r"], r["g"], r["b"]], [0.25, 0.5, 1.0])


def test_3dl_runs_blue_first():
    lines = ["0 1023"] + [f"{r * 1023} {g * 1023} {b * 1023}" for r in (0, 1) for g in (0, 1) for b in (0, 1)]
    size, values = tables.parse_3dl("\n".join(lines))
    assert size == 2 and np.allclose(values[1, 0, 0], [1, 0, 0]) and np.allclose(values[0, 0, 1], [0, 0, 1])


def test_curve_is_monotone_and_meets_its_points(spark):
    curve = tables.monotone_cubic([(0, 0), (0.5, 0.2), (1, 1), (0.5, 0.4)])
    got = [r[0] for r in spark.range(0, 101).select(tables.evaluate_curve(curve, F.col("id") / 100)).collect()]
    assert abs(got[50] - 0.3) < 1e-9 and got[0] == 0 and got[100] == 1 and all(b >= a - 1e-12 for a, b in zip(got, got[1:], strict=False))


def test_plan_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    plan = Plan.of(rows, first_reason((F.col("v").isNull(), "no value"), (F.col("k") > 5, "too large")))
    assert plan.actions.count() == 1 and plan.skipped.first()["reason"] == "no value"
    assert plan.fingerprint(["k", "v"]).first() == Plan.of(rows.repartition(3), first_reason((F.col("v").isNull(), "no value"))).fingerprint(["k", "v"]).first()
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.current() == {}
    store.commit(a=rows, b=rows)
    store.commit(a=store.read("a").where("k = 1"))
    assert store.read("a").count() == 1 and store.read("b").count() == 2
    with pytest.raises(KeyError):
        store.read("c")


def jpeg(order="<", date=b"2024:05:06 07:08:09\0", place=True):
    """A JPEG's head with two directories and a frame of 300 x 200."""
    import struct

    entry = lambda tag, kind, n, value: struct.pack(order + "HHI", tag, kind, n) + value
    number = lambda x: struct.pack(order + "I", x)
    n_main = 3 if place else 2
    detail_at = 8 + 2 + 12 * n_main + 4
    text_at = detail_at + 2 + 12 * 2 + 4
    main = struct.pack(order + "H", n_main) + entry(0x0110, 2, 3, b"X1\0\0") + entry(0x8769, 4, 1, number(detail_at)) + (entry(0x8825, 4, 1, number(0)) if place else b"") + number(0)
    detail = struct.pack(order + "H", 2) + entry(0x9003, 2, len(date), number(text_at)) + entry(0x9011, 2, 7, number(text_at + len(date))) + number(0)
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + number(8) + main + detail + date + b"+02:00\0"
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 200, 300, 1) + b"\0" * 9


def test_exif(spark):
    from tidemark.sources.exif import read_metadata

    rows = [("a", jpeg()), ("b", jpeg(">", b"0000:00:00 00:00:00\0", False)), ("c", b"no picture"), ("d", jpeg()[:40]), ("e", None)]
    got = {r["path"]: r for r in read_metadata(spark.createDataFrame(rows, "path string, content binary")).collect()}
    a, b = got["a"], got["b"]
    assert (a["width"], a["height"], a["camera"], a["has_location"], str(a["capture"]), a["capture_tag"], a["offset_minutes"]) == (300, 200, "X1", True, "2024-05-06 07:08:09", "original", 120)
    assert b["capture"] is None and not b["has_location"] and b["camera"] == "X1"
    assert all(got[k]["width"] is None for k in "ce") and got["d"]["capture"] is None
