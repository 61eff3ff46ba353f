"""As-of matching against plain Python, with the cases that decide its rules."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark import catalog
from tidemark.operators import asof

PROBE, FIX = "probe long, k string, at long", "k string, at long, fix long"


def run(spark, probes, fixes, **how):
    got = asof.match(spark.createDataFrame(probes, PROBE), spark.createDataFrame(fixes, FIX), ["k"], order=["fix"], bucket_seconds=how.pop("bucket_seconds", 10), **how)
    return {r["probe"]: (r["fix"]["fix"] if r["fix"] else None, r["method"], r["gap"]) for r in got.collect()}


def test_exact_wins_and_the_first_fix_after_is_the_last_resort(spark):
    got = run(spark, [(1, "a", 100), (2, "a", 5), (3, "b", 1), (4, "a", None)], [("a", 100, 1), ("a", 99, 2), ("a", 7, 3)])
    assert got == {1: (1, "exact", 0), 2: (3, "nearest", 2), 3: (None, "none", None), 4: (None, "none", None)}


def test_nearest_takes_the_earlier_of_two_as_close(spark):
    assert run(spark, [(1, "a", 50)], [("a", 40, 1), ("a", 60, 2)], method="nearest") == {1: (1, "nearest", 10)}


def test_tolerance_includes_its_limit(spark):
    fixes = [("a", 0, 1)]
    assert run(spark, [(1, "a", 60)], fixes, tolerance=60) == {1: (1, "carried_forward", 60)}
    assert run(spark, [(1, "a", 61)], fixes, tolerance=60) == {1: (None, "none", 61)}


def test_several_fixes_at_one_instant(spark):
    assert run(spark, [(1, "a", 9)], [("a", 5, 1), ("a", 5, 2)])[1][0] == 2


def test_empty_tables(spark):
    assert run(spark, [], [("a", 1, 1)]) == {}
    assert run(spark, [(1, "a", 1)], []) == {1: (None, "none", None)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-60, 60), max_size=12), st.lists(st.integers(-60, 60), max_size=12, unique=True))
def test_against_plain_python(spark, probes, fixes):
    got = run(spark, [(i, "a", t) for i, t in enumerate(probes)], [("a", t, t) for t in fixes], bucket_seconds=7)
    for i, t in enumerate(probes):
        before, after = [f for f in fixes if f <= t], [f for f in fixes if f >= t]
        want = max(before) if before else min(after) if after else None
        assert got[i][0] == want


def test_bracket_has_one_row_on_each_side(spark):
    rows = spark.createDataFrame([(t, t) for t in (1, 5, 10, 11, 20, 30)], "at long, v long")
    assert sorted(r["at"] for r in asof.bracket_window(rows, 10, 12).collect()) == [5, 10, 11, 20]


def test_offset_of_a_clock_is_found(spark):
    fixes = [("a", t * 600, t) for t in range(100)]
    captures = spark.createDataFrame([("a", t * 600 * 3 + 3600) for t in range(10, 20)], "k string, at long")
    best = asof.estimate_offset(captures, spark.createDataFrame(fixes, FIX), ["k"], offsets=(-60, 0, 45, 60)).first()
    assert best["median_gap"] == 0 and 60 in best["plausible"]


def test_offsets_of_all_users_are_scored(spark):
    sf_dir = "/root/testdata/sf0.001"
    probes, fixes = catalog.probes_and_fixes(spark, sf_dir)
    at = {}
    for r in fixes.collect():
        at.setdefault(r["user_id"], []).append(r["at"])
    gaps = {}
    for r in probes.collect():
        for o in asof.UTC_OFFSETS:
            if r["user_id"] in at:
                gaps.setdefault((r["user_id"], o), []).append(min(abs(r["at"] - o * 60 - t) for t in at[r["user_id"]]))
    want = {k: (len(g), sorted(g)[len(g) // 2]) for k, g in gaps.items()}
    got = catalog.QUERIES["offset_scores"](spark, sf_dir).collect()
    assert len(got) == len(want) and {(r["user_id"], r["offset_minutes"]): (r["n"], r["median_gap"]) for r in got} == want
    assert len({u % 10 for u, _ in want}) > 1
