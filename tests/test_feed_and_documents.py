"""The feed of device reports gives each report once over restarts; the document sink commits all or nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import documents, feed, tables, tracks


def put(folder, name, body):
    os.makedirs(folder, exist_ok=True)
    (folder / f"{name}.tmp").write_text(body if isinstance(body, str) else json.dumps(body))
    os.rename(folder / f"{name}.tmp", folder / name)


def fix(at, **more):
    return {"_type": "location", "tst": at, "lat": 1.5, "lon": 2.5, "tid": "pg", **more}


BAD = [{"_type": "lwt"}, fix(5, lat=91.0), {"_type": "location", "tst": 7}, {"tst": 3}, 17, fix(8, tid=" "), fix(9, alt=30)]
REASONS = ["another kind", "place out of range", "time or place missing", "no report", "no report", None, None]


def drain(spark, folder, tmp_path, **options):
    stream = feed.report_stream(spark, str(folder), **options)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return sorted(((r.file, r.ordinal, r.at, r.reason) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()), key=repr)


def test_each_report_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "a.json", fix(1))
    put(folder, "b.json", [fix(2), fix(3)])
    (folder / "half.json.tmp").write_text("not there yet")
    first = [("a.json", 0, 1, None), ("b.json", 0, 2, None), ("b.json", 1, 3, None)]
    assert drain(spark, folder, tmp_path, files_per_task="1") == first
    assert drain(spark, folder, tmp_path) == first  # nothing new
    put(folder, "Z.json", BAD)
    put(folder, "0.json", "{broken")
    got = drain(spark, folder, tmp_path)
    assert got == sorted([*first, ("0.json", None, None, "no document"), *(("Z.json", i, r.get("tst") if isinstance(r, dict) and "_type" in r else None, why) for i, (r, why) in enumerate(zip(BAD, REASONS, strict=True)))], key=repr)
    drain(spark, folder, tmp_path)
    waiting = feed._StreamReader({"path": str(folder)})
    assert set(os.listdir(folder / "_read")) >= {"a.json", "b.json"} and "a.json" not in waiting._waiting()


def test_an_offset_keeps_its_files(tmp_path):
    """A batch that is planned and fails is read again with the same files, whatever has come since."""
    put(tmp_path, "a.json", fix(1))
    one = feed._StreamReader({"path": str(tmp_path)})
    start, end = one.initialOffset(), one.latestOffset()
    put(tmp_path, "0.json", fix(2))
    again = feed._StreamReader({"path": str(tmp_path)})
    assert [p.files for p in again.partitions(start, end)] == [["a.json"]]
    later = again.latestOffset()
    assert [p.files for p in again.partitions(end, later)] == [["0.json"]] and again.latestOffset() == later
    again.commit(end)
    assert [r[3] for p in again.partitions(end, later) for r in again.read(p)] == [2]
    again.commit(later)
    assert feed._StreamReader({"path": str(tmp_path)}).latestOffset() == later


def test_max_files_and_batch_reading(spark, tmp_path):
    for i in range(5):
        put(tmp_path, f"{i}.json", fix(i))
    small = feed._StreamReader({"path": str(tmp_path), "max_files": "2"})
    assert [p.files for p in small.partitions({"entry": 0}, small.latestOffset())] == [["0.json", "1.json"]]
    spark.dataSource.register(feed.DeviceReports)
    assert spark.read.format("device_reports").load(str(tmp_path)).count() == 5


def test_reports_on_lines():
    body = "\n".join([json.dumps(fix(1)), "{broken", json.dumps([fix(2), {"_type": "lwt"}]), ""])
    assert [(r[0], r[2], r[-1]) for r in feed.read_body(body.encode())] == [(0, 1, None), (1, None, "no report"), (2, 2, None), (3, None, "another kind")]


def test_an_empty_file_holds_no_report(spark, tmp_path):
    """As Spark's writer leaves one when its first task has no rows."""
    assert list(feed.read_body(b"")) == list(feed.read_body(b" \n")) == []
    spark.range(3, numPartitions=3).where("id = 2").select(F.lit(json.dumps(fix(7)))).write.text(str(tmp_path / "in"))
    assert sorted(p.stat().st_size > 0 for p in (tmp_path / "in").glob("part-*")) == [False, True]
    assert [(a, why) for _, _, a, why in drain(spark, tmp_path / "in", tmp_path)] == [(7, None)]


POINTS = "track string, at long, lat double, lon double, ele double"


def test_tracks_equal_the_gathered_form_and_come_back(spark, tmp_path):
    rows = [(f"t/{k} é", k * 1000 + i * 7 % 100, k + i / 10, i / 7, None if i % 3 else i / 2) for k in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, POINTS).repartition(3)
    documents.write_tracks(df, str(tmp_path / "out"), key="track")
    got = {r.document: r.text for r in documents.read_documents(spark, str(tmp_path / "out")).collect()}
    want = {r.track: r.gpx for r in tracks.write_gpx(df, "track").collect()}
    assert got == want and not any("<ele>n" in t for t in got.values())
    back = tracks.read_documents(documents.read_documents(spark, str(tmp_path / "out")).select(F.col("text").alias("value"), F.col("document").alias("file")))
    assert sorted((r.file, r.at) for r in back.collect()) == sorted({(t, at) for t, at, *_ in rows})


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    documents.write_documents(spark.createDataFrame([("kept", "text")], "name string, body string"), str(out), document="name", order=[], text="body")
    before = sorted(str(p.relative_to(out)) for p in out.rglob("*"))
    rows = spark.range(2000).select(F.concat(F.lit("d"), F.col("id") % 50).alias("name"), F.when(F.col("id") == 1999, F.raise_error(F.lit("broken row"))).otherwise("x").alias("body"), "id")
    with pytest.raises(Exception, match="broken row"):
        documents.write_documents(rows, str(out), document="name", order=["id"], text="body")
    with pytest.raises(Exception, match="needs a name"):
        documents.write_documents(spark.createDataFrame([(None, "x"), ("b", "y")], "name string, body string"), str(out), document="name", order=[], text="body")
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*")) == before
    assert [tuple(r) for r in documents.read_documents(spark, str(out)).collect()] == [("kept", "text")]


def test_append_and_overwrite(spark, tmp_path):
    put_rows = lambda name, mode: documents.write_documents(spark.createDataFrame([(name, "1", 2), (name, "0", 1)], "name string, body string, n int"), str(tmp_path), document="name", order=["n"], text="body", mode=mode)
    put_rows("a", "append")
    put_rows("b", "append")
    assert sorted(tuple(r) for r in documents.read_documents(spark, str(tmp_path)).collect()) == [("a", "01"), ("b", "01")]
    put_rows("c", "overwrite")
    assert [tuple(r) for r in documents.read_documents(spark, str(tmp_path)).collect()] == [("c", "01")]
    assert len(list(tmp_path.glob("job-*"))) == 1


def test_stream_of_documents(spark, tmp_path):
    documents.register(spark)
    rows = lambda *names: spark.createDataFrame([(n, n * 2) for n in names], "document string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def drain():
        stream = spark.readStream.schema("document string, text string").parquet(str(tmp_path / "in"))
        stream.writeStream.format("documents").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in documents.read_documents(spark, str(tmp_path / "out")).collect())

    rows("a", "b")
    assert drain() == [("a", "aa"), ("b", "bb")]
    rows("c")
    assert drain() == [("a", "aa"), ("b", "bb"), ("c", "cc")]


def test_presets(spark, tmp_path):
    body = json.dumps({"version": 2, "exposure": 0.5})
    rows = spark.createDataFrame([("soft light", body), (" warm ", body), ("", body)], "name string, body string")
    bad = documents.write_presets(rows, str(tmp_path / "p"))
    assert [r.name for r in bad.collect()] == [""]
    got = documents.read_documents(spark, str(tmp_path / "p")).select("document", tables.recipe(F.col("text"))["exposure"].alias("exposure"))
    assert sorted(tuple(r) for r in got.collect()) == [("soft light", 0.5), ("warm", 0.5)]
