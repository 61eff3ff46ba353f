"""A scan of files and folders: dates, sidecars and places of small files made here."""

import json

from test_containers import exif, jpeg, quicktime, segment

from tidemark.sources import scan


def put(path, body=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body if isinstance(body, bytes) else json.dumps(body).encode())
    return str(path)


def sidecar(at=None, lat=0.0, lon=0.0):
    return {"photoTakenTime": {"timestamp": str(at)}, "geoData": {"latitude": lat, "longitude": lon}} if at else {"other": 1}


def test_scan_of_mixed_inputs(spark, tmp_path):
    front, moov = quicktime()
    dated = jpeg(segment(0xE1, b"Exif\0\0" + exif()))
    a = put(tmp_path / "in/a.jpg", dated)
    put(tmp_path / "in/a.jpg.json", sidecar(1_600_000_000, 1.0, 2.0))
    b = put(tmp_path / "in/deep/er/b.jpg", jpeg())
    put(tmp_path / "in/deep/er/b.jpg.json", sidecar(1_600_000_000, 1.0, 2.0))
    c = put(tmp_path / "in/deep/c(1).jpg", jpeg())
    put(tmp_path / "in/deep/c.jpg(1).json", sidecar(1_500_000_000))
    put(tmp_path / "in/deep/c.jpg.json", sidecar(1_400_000_000))
    d = put(tmp_path / "in/d.jpg", jpeg())
    put(tmp_path / "in/d.jpg.json", b"no json")
    e = put(tmp_path / "alone.mov", front + moov)
    f = put(tmp_path / "in/f.jpg", b"")
    put(tmp_path / "in/notes.txt")
    put(tmp_path / "in/.hidden/g.jpg", dated)
    missing = str(tmp_path / "none.jpg")
    got = {r.path: r for r in scan.scan(spark, [str(tmp_path / "in"), e, missing, str(tmp_path / "in/deep")]).collect()}
    assert set(got) == {a, b, c, d, e, f, missing}
    facts = lambda p: (str(got[p].taken) if got[p].taken else None, got[p].taken_from, got[p].placed_from, got[p].problem)
    assert facts(a) == ("2024-05-06 07:08:09", "original", "file", None) and got[a].sidecar.endswith("a.jpg.json") and round(got[a].lat, 2) == -10.51
    assert facts(b) == ("2020-09-13 12:26:40", "sidecar", "sidecar", None) and (got[b].lat, got[b].lon) == (1.0, 2.0)
    assert facts(c) == ("2017-07-14 02:40:00", "sidecar", None, None) and got[c].sidecar.endswith("c.jpg(1).json")
    assert facts(d) == (None, None, None, None) and got[d].sidecar is not None
    assert facts(e) == ("2023-11-14 23:13:20", "created_local", "file", None) and got[e].root == e and got[e].kind == "video"
    assert facts(f)[3] == "unknown kind" and facts(missing)[3] == "not there"
    assert got[a].root == got[b].root == str(tmp_path / "in") and got[b].size == len(jpeg()) and got[a].container == "jpeg"


def test_inputs_that_meet_and_flat_scans(spark, tmp_path):
    put(tmp_path / "x/a.jpg")
    put(tmp_path / "x/y/b.jpg")
    rows = spark.createDataFrame([(str(tmp_path / "x"),), (str(tmp_path / "x"),), (str(tmp_path / "x/a.jpg"),), (None,)], "path string")
    assert sorted((r.path[len(str(tmp_path)) :], r.size) for r in scan.expand(rows).collect()) == [("/x/a.jpg", 1), ("/x/y/b.jpg", 1)]
    assert [r.path[len(str(tmp_path)) :] for r in scan.expand(rows, recursive=False).collect()] == ["/x/a.jpg"]
    assert scan.expand(rows.limit(0)).collect() == []
