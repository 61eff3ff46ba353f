from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.staging import shared_dir
from tidemark.streaming import rollup

FIX = "device string, at long, lat double, lon double, received_at long"


def test_late_and_repeated_fixes(spark, tmp_path):
    source, store = tmp_path / "in", rollup.Days(spark, str(tmp_path / "store"))
    fixes = lambda *rows: spark.createDataFrame(list(rows), FIX).coalesce(1).write.mode("append").json(str(source))

    def drain():
        stream = spark.readStream.schema(FIX).json(str(source))
        stream.writeStream.foreachBatch(rollup.roll_up(store)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    fixes(("a", 10, 1.0, 1.0, 1), ("a", 86_410, 1.0, 1.0, 2), ("b", 10, 2.0, 2.0, 3))
    drain()
    before = {(r["device"], r["day"]): r["track_id"] for r in store.read("tracks").collect()}
    fixes(("a", 20, 1.0, 1.0, 99), ("b", 10, 9.0, 9.0, 99))
    drain()
    after = {(r["device"], r["day"]): r["track_id"] for r in store.read("tracks").collect()}
    assert store.read("fixes").count() == 4
    assert after[("a", 0)] != before[("a", 0)]
    assert after[("b", 0)] == before[("b", 0)] and after[("a", 86_400)] == before[("a", 86_400)]
    rollup.roll_up(store)(store.read("fixes"), 7)  # a batch again
    assert {(r["device"], r["day"]): r["track_id"] for r in store.read("tracks").collect()} == after


def table_of(spark, df, tmp_path, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_once_each_and_quiet_keys(spark, tmp_path):
    rows = [("x", 1000), ("x", 1060), ("x", 3000), ("y", 1030), ("y", 1030), ("z", 9900)]
    spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    assert len(table_of(spark, rollup.once_each(stream(), ["k", "ts"]), tmp_path, "once")) == 5
    quiet = table_of(spark, rollup.quiet_keys(stream(), "k", quiet="10 minutes"), tmp_path, "quiet")
    assert sorted((r["k"], r["n"]) for r in quiet) == [("x", 1), ("x", 2), ("y", 2)]


def test_drained_streams_are_files_in_the_shared_folder(spark, tmp_path):
    spark.range(100).withColumn("ts", F.timestamp_seconds(F.col("id") + 1_000_000)).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in"))
    got = catalog.drained(rollup.once_each(stream, ["id"], grace="1 day").select("id"))
    assert sorted(r["id"] for r in got.collect()) == list(range(100))
    assert got.inputFiles() and all(shared_dir(spark) in f.replace("file:///", "file:/").replace("file:/", "file:///") for f in got.inputFiles())
    assert catalog.drained(stream.where("id < 0").select("id")).count() == 0
