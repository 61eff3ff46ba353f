"""Repair and publish planning, reads, neighbours, order statistics and places against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import asof, ledger, publishing, reads, repair, sequence, shots, stats
from tidemark.plans.plan import Snapshots
from tidemark.sources import tables

LIMITS = {"card": "card", "ident": "shot", "now": 40 * 86_400, "max_age_days": 10, "max_bytes": 100, "megapixels": 1.0, "output_dir": "out/"}
SHOT = "shot long, card string, stem string, capture long, modified long, width int, height int"


def plans(spark, rows, failure, action, **how):
    frame = spark.createDataFrame(rows, SHOT)
    found = frame.select("shot", F.lit(failure).alias("failure"))
    plan = repair.plan_bulk(frame, found, failure, action, **LIMITS | how)
    return {r["shot"]: r for r in plan.actions.collect()}, {r["shot"]: r["reason"] for r in plan.skipped.collect()}


def test_bulk_repairs(spark):
    rows = [(1, "a", "s1", 100, 7, 2000, 1000), (2, "a", "s2", None, -1, 10, 10), (3, "a", "s3", 200, None, 0, 5), (4, None, "s4", 300, 9, 4000, 4000)]
    with pytest.raises(ValueError, match="not offered"):
        plans(spark, rows, "no_date", "resize")
    assert plans(spark, rows, "no_date", "enter_date_manually")[1].keys() == {1, 2, 3, 4}
    assert {k: r["new_date"] for k, r in plans(spark, rows, "no_date", "enter_date_manually", date=5)[0].items()} == dict.fromkeys([1, 2, 3, 4], 5)
    assert {k: r["new_date"] for k, r in plans(spark, rows, "no_date", "derive_from_batch_median")[0].items()} == {1: 200, 2: 200, 3: 200, 4: 300}
    done, left = plans(spark, rows, "no_date", "use_file_modification_time")
    assert set(done) == {1, 4} and left == {2: "modified before the epoch", 3: "modification time missing"}
    done, left = plans(spark, rows, "date_out_of_range_batch", "bulk_shift")
    assert {k: r["new_date"] for k, r in done.items()} == {1: 100 + 40 * 86_400 - 200, 3: 40 * 86_400, 4: 40 * 86_400} and left == {2: "undated, so nothing to move"}
    done, left = plans(spark, rows, "too_many_pixels", "resize")
    assert {k: (r["target_width"], r["target_height"], r["destination"]) for k, r in done.items()} == {1: (1414, 707, "out/s1.jpg"), 4: (1000, 1000, "out/s4.jpg")}
    assert set(left) == {3}  # the second fits: nothing to do, and nothing wrong
    assert set(plans(spark, rows, "too_large", "skip")[0]) == {1, 2, 3, 4}
    assert plans(spark, [], "too_large", "reencode_lower") == ({}, {})


def test_publishing(spark):
    planned = spark.createDataFrame([("s", f"f{k}", f"st{k}", d) for k, d in enumerate(["send", "already_published", "already_staged", "send", "send"])], "session_id string, file_name string, stem string, disposition string")
    manifest = spark.createDataFrame([(f"f{k}", f"st{k}", f"h{k}", 10) for k in (0, 1, 2, 4)], "file_name string, stem string, source_sha256 string, bytes long")
    report = spark.createDataFrame([("f0", "verified"), ("f2", "short_file")], "file_name string, outcome string")
    plan = publishing.publishable(planned, manifest, report)
    assert [r["shot_id"] for r in plan.actions.collect()] == ["s:h0"]
    why = {r["stem"]: r["reason"] for r in plan.skipped.collect()}
    assert why == {"st1": "already published", "st2": "the staged file is short_file", "st3": "not in the session's manifest", "st4": "the staged file is not verified"}
    assert {r["reason"] for r in publishing.publishable(planned, manifest, None).skipped.collect()} == {"already published", "not in the session's manifest", "the staged files have not been verified yet"}
    assert publishing.name_a_few(plan.skipped).first()["text"].endswith("(not in the session's manifest), and 1 more")
    assert publishing.name_a_few(plan.skipped.limit(0)).first()["text"] == ""
    none = publishing.publish_totals(plan.actions.limit(0), spark.createDataFrame([], "shot_id string, state string")).first()
    assert (none["total_bytes"], none["uploads"], none["batches"]) == (0, 0, 0)


def test_free_names_fill_gaps(spark):
    wanted = spark.createDataFrame([(k, "Look.JPG") for k in range(4)] + [(9, "plain")], "id int, target string")
    there = spark.createDataFrame([("look.jpg",), ("LOOK_2.jpg",), ("look_x.jpg",), ("other_1.jpg",)], "name string")
    got = {r["id"]: r["free_name"] for r in repair.free_names(wanted, there, "target", ["id"]).collect()}
    assert got == {0: "Look_1.JPG", 1: "Look_3.JPG", 2: "Look_4.JPG", 3: "Look_5.JPG", 9: "plain"}


def test_reads(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 6), (3, "b", None)], "k int, s string, at long")
    ks = lambda df: [r["k"] for r in df.collect()]
    assert ks(reads.read(rows, {"s": None})) == [2] and ks(reads.read(rows, {"at": (5, 6)}, order=["-k"])) == [2, 1] and ks(reads.read(rows, {"k": [1, 3]}, ["k"])) == [1, 3]
    assert ks(reads.delete_range(rows, "at", 5, 5)) == [2, 3] and ks(reads.page(rows, ["k"], 1, 1)) == [2]
    assert ks(reads.points_at(rows, rows.where("k = 2").union(rows.where("k = 2")))) == [2]


@pytest.mark.parametrize("after", [False, True])
def test_the_row_before_or_after(spark, after):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(0, 1000, 7)]), i, rng.random()) for i in range(200)]
    frame = spark.createDataFrame(rows, "key string, at long, id int, v double")
    got = {r["id"]: r["next_v"] for r in sequence.with_neighbour(frame, ["key"], ["at", "id"], {"next_v": "v"}, after=after, bucket=50).collect()}
    want = {}
    for key in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for i, r in enumerate(mine):
            j = i + 1 if after else i - 1
            want[r[2]] = mine[j][3] if 0 <= j < len(mine) else None
    assert got == want


def test_order_statistics_narrow_until_little_is_left(spark):
    """One value far out, one that stands very often, nulls and single rows; at most ten values are ever put in order."""
    rng = random.Random(1)
    rows = [("far", rng.random()) for _ in range(300)] + [("far", 1e12)] + [("often", 5.0)] * 200 + [("often", rng.random()) for _ in range(50)] + [("one", 2.0), ("null", None), (None, 3.0), (None, 4.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n"], r["v"]) for r in stats.kth_value(frame, ["k"], "v", F.floor(F.col("n") / 2), bins=8, most=10).collect()}
    lists = {k: sorted(v for x, v in rows if x == k and v is not None) for k in ("far", "often", "one", None)}
    assert got == {k: (len(v), v[len(v) // 2]) for k, v in lists.items()}
    assert stats.kth_value(frame, [], "v", F.lit(0), bins=8, most=10).first()["v"] == min(v for _, v in rows if v is not None)


def test_batches_within_keys(spark):
    rows = [(k % 3 if k % 7 else None, k) for k in range(100)]
    got = ledger.batches_of(spark.createDataFrame(rows, "key int, id int"), ["id"], 10, ["key"]).collect()
    place = {}
    for key in (0, 1, 2, None):
        place |= {i: n // 10 for n, i in enumerate(sorted(i for k, i in rows if k == key))}
    assert {r["id"]: r["batch"] for r in got} == place


def test_placed_points_are_two_one_or_none(spark):
    stops = spark.createDataFrame([("a", 1, 0, 10, 5.0, 5.0), ("a", 2, 10, 10, 5.0, 5.0), ("a", 3, 20, 15, 5.0, 5.0), ("a", 4, 30, 50, 5.0, 5.0), ("a", 5, 40, 60, 95.0, 5.0), ("a", 6, 45, 70, 5.0, 5.0)], "k string, id int, a long, b long, lat double, lon double")
    points, refused = asof.placed_points(stops, ["k"], "a", "b", "id")
    assert sorted((r["id"], r["at"]) for r in points.collect()) == [(1, 0), (1, 10), (2, 10), (6, 45), (6, 70)]
    assert {r["id"]: r["problem"] for r in refused.collect()} == {3: "inverted", 4: "overlaps next", 5: "no place on Earth"}


def test_a_snapshot_that_fails_leaves_the_last_one(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    rows = spark.range(3)
    store.commit(a=rows, b=rows)
    with pytest.raises(Exception, match="boom"):
        store.commit(a=spark.range(9), b=rows.select(F.raise_error(F.lit("boom")).alias("x")))
    assert store.read("a").count() == 3
    other = Snapshots(spark, str(tmp_path / "s"))
    other.commit(b=spark.range(1))
    assert store.read("b").count() == 1 and store.read("a").count() == 3


def test_presets_and_looks(spark, tmp_path):
    rows = spark.createDataFrame([("Warm", '{"exposure": 1.5, "version": 2}'), ("New", '{"version": 3}'), ("Broken", "{"), (".hidden", "{}")], "name string, body string")
    refused = tables.write_presets(rows, str(tmp_path / "p"))
    assert [r["name"] for r in refused.collect()] == [".hidden"]
    with pytest.raises(Exception, match="already exists"):
        tables.write_presets(rows, str(tmp_path / "p"))
    (tmp_path / "q").mkdir()
    for name, body in (("Warm", '{"exposure": 1.5}'), ("New", '{"version": 3}'), ("Broken", "{")):
        (tmp_path / "q" / f"{name}.json").write_text(body)
    good, bad = tables.read_presets(spark, str(tmp_path / "q"))
    assert [(r["name"], r["recipe"]["exposure"], r["recipe"]["version"]) for r in good.collect()] == [("Warm", 1.5, 1)]
    assert {r["name"]: r["problem"] for r in bad.collect()} == {"New": "unsupported version", "Broken": "malformed"}


def test_a_bulk_plan_is_not_packed_into_one_task(spark):
    """A shot that fails a check twice is planned once."""
    frame = spark.range(400).select(F.col("id").alias("shot"), F.lit("a").alias("card"), F.lit("s").alias("stem"), *(F.lit(1).cast("long").alias(c) for c in ("capture", "modified", "width", "height")))
    found = frame.select("shot", F.lit("no_date").alias("failure")).where("shot < 300")
    plan = repair.plan_bulk(frame, found.unionByName(found), "no_date", "enter_date_manually", **LIMITS | {"date": 5})
    rows = plan.actions.select("shot", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.shot for r in rows) == list(range(300)) and len({r.task for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_library_of_presets_is_few_files(spark, tmp_path):
    """Names that look like numbers and bodies of several lines come back as they were."""
    body = '{"exposure":\n0.5}'
    rows = spark.range(100, numPartitions=2).select(F.format_string("%03d", "id").alias("name"), F.lit(body).alias("body"))
    tables.write_presets(rows, str(tmp_path / "p"))
    assert len([f for f in (tmp_path / "p").rglob("*") if f.name.startswith("part-")]) == 2 and not [f for f in (tmp_path / "p").iterdir() if f.is_dir()]
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).select("name", "body").collect()) == [(f"{i:03d}", body) for i in range(100)]


def test_places_in_stored_pictures_come_back(spark):
    """Orientation 6 is a quarter turn: four of them give the place again; no edit gives it at once."""
    place = lambda *a: tuple(spark.range(1).select(geo.stored_place(*(F.lit(x) for x in a)).alias("p")).first()["p"])
    assert place(3.0, 4.0, 40.0, 60.0, 0, False, False, 1) == (3.0, 4.0)
    assert place(3.0, 4.0, 40.0, 60.0, 2, True, True, 1) == (3.0, 4.0)
    x, y, w, h = 3.0, 4.0, 40.0, 60.0
    for _ in range(4):
        (x, y), w, h = place(x, y, w, h, 0, False, False, 6), h, w
    assert (x, y) == (3.0, 4.0)


def test_rungs(spark):
    rung = shots.first_rung({"a": (F.lit(None).cast("int"), F.lit("no")), "b": (F.lit(3), F.lit("never said"))})
    assert tuple(spark.range(1).select(rung.alias("r")).first()["r"]) == ("b", 3, "a: no")
