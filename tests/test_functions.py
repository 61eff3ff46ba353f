from pyspark.sql import functions as F

from tidemark.functions import colour, dates, geo, text
from tidemark.operators import arrays, checks, ledger, shots, stats, timeline


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    lit = F.lit
    assert one(spark, text.stem(lit("DCIM/IMG_1.CR2"))) == "IMG_1"
    assert one(spark, text.stem(lit(".hidden"))) == ".hidden"
    assert one(spark, text.media_kind(lit("a/B.JPG"))) == "jpeg"
    assert one(spark, text.leading_number(lit("x12y3"))) == 12
    assert one(spark, text.leading_number(lit("none"))) is None
    assert one(spark, text.leading_number(lit("9" * 30))) is None
    assert one(spark, text.sanitise_date(lit("on 2024-05-06!"))) == "2024-05-06"
    assert one(spark, text.sanitise_date(lit("1-2"))) is None
    assert one(spark, text.build_prefix(lit("a"), lit(""), lit(None).cast("string"), lit("b"))) == "a-b"
    assert one(spark, text.sidecar_candidates(lit("p(1).jpg"))) == ["p(1).jpg.json", "p.jpg(1).json", "p.jpg.json"]
    assert one(spark, text.duplicate_suffix(lit("p.jpg"))) is None
    assert one(spark, text.slug(lit("Été 1.jpg"))) == "Été-1-jpg"
    assert one(spark, text.fill_template(lit("{name} {edit}"), name=lit("a/b"), edit=lit("x"))) == "a-b x"
    assert one(spark, text.fill_template(lit("{name}"), name=lit("..."))) is None
    assert one(spark, text.shorten_caption(lit("x" * 30 + ".jpg"))) == "x" * 18 + "....jpg"
    assert one(spark, text.xml_escape(lit("<a & 'b'>"))) == "&lt;a &amp; 'b'&gt;"
    assert one(spark, text.decode_base64(lit("%%%"))) is None
    assert [one(spark, text.human_bytes(lit(n))) for n in (0, 1023, 1536, 3 << 20, 3 << 30)] == ["no bytes", "1023 B", "1.5 KB", "3.0 MB", "3072.0 MB"]
    assert one(spark, text.sidecar_candidates(lit("x" * 50 + "(1).jpg")))[3:] == ["x" * 46 + ".json"]
    assert [one(spark, text.name_problem(lit(n))) for n in (" ", "x" * 65, "a:b", ".a", " a b ")] == ["empty", "longer than 64 characters", "a sign that is not allowed", "starts with a dot", None]
    assert one(spark, text.seed_of(lit("f" * 64))) == 2**64 - 1 and one(spark, text.seed_of(lit("x"))) is None
    none = lit(None).cast("string")
    assert one(spark, text.run_summary(lit(0), "files written", lit(0), lit(0), none, ["jpg"])) == "No work: no file matched. Accepted: .jpg. Subfolders are read only on request."
    assert one(spark, text.run_summary(lit(0), "files written", lit(0), lit(2), lit("no date"))) == 'No work: 2 skipped; first reason: "no date".'
    assert one(spark, text.run_summary(lit(3), "files written", lit(1), lit(2), lit("no date"))) == "3 files written, 1 failed, 2 skipped"
    assert one(spark, text.page_name(lit("a"), lit(2), lit(3))) == "a_p002.jpg"


def test_dates(spark):
    lit = F.lit
    for written in ("2024:01:02 03:04:05", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05.75"):
        assert str(one(spark, dates.normalise_datetime(lit(written)))) == "2024-01-02 03:04:05"
    assert str(one(spark, dates.normalise_datetime(lit("2024:01:02")))) == "2024-01-02 00:00:00"
    for bad in ("0000:00:00 00:00:00", "", "soon", "2024:13:02 00:00:00"):
        assert one(spark, dates.normalise_datetime(lit(bad))) is None
    assert one(spark, dates.best_date({"a": lit("x"), "b": lit("2024:01:02")}))["tag"] == "b"
    assert one(spark, dates.utc_offset_minutes(lit("-03:30"))) == -210
    offsets = {"+14:59": 899, "05:45": 345, "+5:30": 330, '"+02:00"': 120, "  +02:00  ": 120, "-03:30": -210} | dict.fromkeys(["", " ", "+", "02:00:00 ", "+15:00", "+02:99", "Z", "+aa:bb"])
    for written, minutes in offsets.items():
        assert one(spark, dates.utc_offset_minutes(lit(written))) == minutes, written
    assert one(spark, dates.shift_magnitude(dates.shift_parts(lit("-1:2:3 4:5:6")))) == "1:2:3 4:5:6"
    shifted = dates.apply_shift(F.lit("2024-01-31 00:00:00").cast("timestamp"), dates.shift_parts(lit("+0:1:1 0:0:0")))
    assert str(one(spark, shifted)) == "2024-03-01 00:00:00"
    assert one(spark, dates.shift_parts(lit("1 day"))) is None
    assert one(spark, dates.day_start(lit(-1), 0)) == -86_400
    assert one(spark, dates.local_day(lit(-1), 0)) == -1
    assert one(spark, dates.instant(lit("2024-01-01T00:00:00.9Z"))) == 1_704_067_200
    assert one(spark, dates.instant(lit("2024-01-01T01:00:00+01:00"))) == 1_704_067_200
    assert one(spark, dates.rfc3339(lit(1_704_067_200))) == "2024-01-01T00:00:00Z"
    assert one(spark, dates.format_shift(lit(-90_061))) == "-0:0:1 1:1:1"
    assert one(spark, dates.elapsed_days(lit(0), lit(2 * 86_400 - 1))) == 1
    said = {90: "90 s", 120: "2 min", 5000: "83 min", 7200: "2 h", 7260: "2 h 1 min", 100_000: "27 h 46 min", 172_800: "2 days", 200_000: "2 days 7 h", -90: "90 s"}
    assert {s: one(spark, dates.duration(lit(s))) for s in said} == said


def test_places(spark):
    lit, none = F.lit, F.lit(None).cast("double")
    assert round(one(spark, geo.metres_between(lit(0.0), lit(0.0), lit(0.0), lit(1.0)))) == 111_195
    same = lambda a, b: one(spark, geo.same_position(lit(1.0), lit(1.0), a, lit(1.0 + 5e-7), lit(1.0), b))
    assert same(none, none) and not same(none, lit(0.0)) and same(lit(1.0), lit(1.5)) and not same(lit(1.0), lit(1.6))
    assert one(spark, geo.fit_megapixels(lit(6000), lit(4000), 24.0)) is None
    assert tuple(one(spark, geo.fit_megapixels(lit(6000), lit(4000), 6.0))) == (3000, 2000)
    assert tuple(one(spark, geo.inscribed(lit(100.0), lit(50.0), lit(0.0)))) == (100.0, 50.0)
    assert tuple(one(spark, geo.print_canvas(lit(2), lit(3), 3000))) == (3000, 3750) and tuple(one(spark, geo.print_canvas(lit(3), lit(3), 3000))) == (3000, 2400)
    point = one(spark, geo.exif_position(lit(1_704_067_200), lit(-1.5), lit(2.25), lit(-3.0)))
    assert tuple(point) == ("1.5000000", "S", "2.2500000", "E", "3.000", 1, "2024:01:01", "00:00:00")
    assert one(spark, geo.exif_position(lit(0), lit(0.0), lit(0.0), lit(5.0), with_altitude=False))["altitude"] is None
    assert tuple(one(spark, geo.grid_cell(lit(5), 3, 10, 20, 1))) == (22, 21)


def test_colour(spark):
    x = F.lit(0.5)
    assert abs(one(spark, colour.linear_to_srgb(colour.srgb_to_linear(x))) - 0.5) < 1e-9
    back = colour.from_oklab(*colour.oklab(F.lit(0.2), F.lit(0.4), F.lit(0.6)))
    assert [round(one(spark, c), 4) for c in back] == [0.2, 0.4, 0.6]
    table = F.array(*(F.lit(float(v)) for v in (0, 10, 40)))
    assert one(spark, colour.lookup_lerp(table, F.lit(0.75))) == 25.0
    assert -1 <= one(spark, colour.noise(1, F.lit(2), F.lit(3))) <= 1
    high, low = colour.tone_weights(F.lit(0.18))
    assert one(spark, high) == one(spark, low) == 0.0 and one(spark, colour.tone_weights(F.lit(0.7))[0]) == 1.0 == one(spark, colour.tone_weights(F.lit(0.04))[1])
    parts = [one(spark, w) for w in colour.range_weights(F.lit(0.3), F.lit(10.0), F.lit(50.0))]
    assert abs(sum(parts) - 1) < 1e-12 and 0 < parts[0] < 1
    assert [one(spark, colour.base_tone(F.lit(v))) for v in (-1.0, 0.4, 0.6, 1.0, 2.0)] == [0.0, 0.5, 0.75, 1.0, 1.0]
    assert one(spark, colour.luma_709(F.lit(255), F.lit(255), F.lit(255))) == 255


def test_arrays(spark):
    a = F.array(*(F.lit(v) for v in (3, 1, 1, 5)))
    empty = F.array().cast("array<int>")
    assert one(spark, arrays.first_minimum(a)) == 1
    assert one(spark, arrays.border_run(a, 3)) == 3
    assert one(spark, arrays.fraction_at_or_above(empty, 1)) == 0.0
    assert one(spark, arrays.sliding_min(a, 1)) == [1, 1, 1, 1]
    assert one(spark, arrays.arg_max_last(F.array(F.lit(2), F.lit(7), F.lit(7)))) == 2
    mask = F.array(*(F.struct(F.lit(o).alias("op"), F.lit(v).alias("value")) for o, v in (("add", 0.8), ("subtract", 0.5), ("intersect", 0.5))))
    assert one(spark, arrays.compose_mask(mask)) == 0.2


def test_order_statistics(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 7), ("b", None), (None, 5), (None, 5)], "k string, v long")
    assert {r["k"]: r["v"] for r in stats.upper_median(rows, ["k"], "v").collect()} == {"a": 3, "b": 7, None: 5}
    assert {r["k"]: r["v"] for r in stats.nearest_rank(rows, ["k"], "v", 0.5).collect()} == {"a": 2, "b": 7, None: 5}
    assert stats.upper_median(rows.limit(0), ["k"], "v").count() == 0
    many = spark.range(20_001).selectExpr("id * 37 % 20001 AS v", "1 AS k")
    assert stats.upper_median(many, ["k"], "v").first()["v"] == 10_000
    hist = stats.histogram_256(rows, ["k"], "v")
    assert hist.where("k = 'a'").agg(F.sum("n")).first()[0] == 4 and hist.where("k = 'a'").count() == 256
    assert stats.mode_of(rows, ["k"], "v").where("k = 'a'").first()["v"] == 1


def test_merges(spark):
    held = spark.createDataFrame([(1, "old", 1), (2, "old", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "b", 2), (2, "a", 3), (3, None, 2)], "k int, v string, n int")
    take = lambda df: sorted((r["k"], r["v"]) for r in df.collect())
    assert take(ledger.insert_or_ignore(held, new.where("k < 3"), ["k"], ["n"])) == [(1, "old"), (2, "old")]
    assert dict(take(ledger.insert_or_replace(held, new, ["k"], [-F.col("n")])))[2] == "a"
    once = new.where("v is null or v = 'a'")
    assert dict(take(ledger.upsert(held, once, ["k"], keep_old_if_null=["v"]))) == {1: "old", 2: "a", 3: None}
    assert ledger.insert_or_ignore(held.limit(0), new, ["k"], ["n"]).count() == 2


def test_sync_can_delete_on_both_sides_and_keeps_equal_times(spark):
    side = "id string, imported_at long, has_text boolean"
    here, there = spark.createDataFrame([("x", 1, True), ("t", 5, False), ("e", 5, True)], side), spark.createDataFrame([("x", 1, True)], side)
    gone = spark.createDataFrame([("x", 2), ("e", 5)], "id string, deleted_at long")
    got = {r["id"]: r.asDict() for r in timeline.sync_plan(here, there, gone, gone).collect()}
    assert got["x"]["delete_here"] and got["x"]["delete_there"]
    assert got["t"]["unsendable"] and not got["t"]["push"]
    assert got["e"]["push"] and not got["e"]["delete_here"]


def test_shots_fold_case_and_prefer_jpeg(spark):
    rows = spark.createDataFrame([("img_1", "raw", 9, "b"), ("IMG_1", "jpeg", 1, "a"), ("IMG_2", "raw", 1, "c"), ("IMG_3", "other", 1, "d")], "stem string, kind string, bytes long, rel_path string")
    got = {r["stem"]: r for r in shots.group_into_shots(rows).collect()}
    assert set(got) == {"IMG_1", "IMG_2"} and not got["IMG_1"]["needs_derivation"] and got["IMG_2"]["needs_derivation"]


def test_limits_are_inclusive_and_worst_wins(spark):
    assert one(spark, checks.check_size(F.lit(10), 10))["status"] == "pass"
    assert one(spark, checks.check_resolution(F.lit(3000), F.lit(2000), 6.0))["status"] == "pass"
    assert one(spark, checks.check_resolution(F.lit(3000), F.lit(2001), 6.0))["status"] == "fail"
    assert one(spark, checks.check_resolution(F.lit(None).cast("int"), F.lit(2001), 6.0))["status"] == "warn"
    rows = spark.createDataFrame([("a", "warn"), ("a", "pending"), ("b", "pass"), ("b", "fail")], "k string, status string")
    assert {r["k"]: r["status"] for r in checks.worst_status(rows, ["k"]).collect()} == {"a": "warn", "b": "fail"}
