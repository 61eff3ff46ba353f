"""Strokes, neighbourhoods, sliders, colour fits and checked plans against plain Python and numpy."""

import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog, catalog_pixels  # noqa: F401  it adds queries
from tidemark.operators import coverage, fit
from tidemark.plans.plan import Plan, PlanMoved, Snapshots

SF = "/root/testdata/sf0.001"


def painted(strokes, w, h):
    """alpha and beta of every pixel, stroke by stroke and segment by segment."""
    alpha, beta = np.ones((h, w)), np.zeros((h, w))
    for points, radius, feather, flow, erase in strokes:
        r = max(min(max(radius, 0.0005), 0.5) * max(w, h), 0.5)
        inner = r * (1 - min(max(feather, 0), 1))
        px = [(x * w, y * h) for x, y in points]
        s = np.zeros((h, w))
        for (ax, ay), (bx, by) in zip(px, px[1:], strict=False) if len(px) > 1 else [(p, p) for p in px]:
            dx, dy = bx - ax, by - ay
            for y in range(h):
                for x in range(w):
                    qx, qy = x + 0.5, y + 0.5
                    t = min(max(((qx - ax) * dx + (qy - ay) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
                    d = math.hypot(qx - ax - t * dx, qy - ay - t * dy)
                    if d < r:
                        u = min(max((d - inner) / max(r - inner, 1e-6), 0), 1)
                        s[y, x] = max(s[y, x], (1 if d <= inner else 1 - u * u * (3 - 2 * u)) * min(max(flow, 0), 1))
        alpha *= 1 - s
        beta = beta * (1 - s) + (0 if erase else s)
    return alpha, beta


@pytest.mark.parametrize("tile, fold", [(16, 64), (4, 2)])
def test_strokes(spark, monkeypatch, tile, fold):
    monkeypatch.setattr(coverage, "TILE", tile)
    monkeypatch.setattr(coverage, "FOLD", fold)
    rng = random.Random(tile)
    at = lambda: (rng.uniform(-0.1, 1.1), rng.uniform(-0.1, 1.1))
    frames = {"a": (37, 23), "b": (20, 41), "hot": (12, 12)}
    strokes = {f: [([at() for _ in range(rng.choice([1, 2, 5]))], rng.choice([0.0, 0.03, 0.2]), rng.choice([0.0, 0.5, 1.0]), rng.choice([0.3, 1.0, 2.0]), rng.random() < 0.4) for _ in range(9)] for f in ("a", "b")}
    strokes["hot"] = [([(0.5, 0.5)], 0.1, 0.5, 0.05, k % 3 == 0) for k in range(150)]
    rows = [(f, k, [dict(x=x, y=y) for x, y in p], r, fe, fl, e) for f, own in strokes.items() for k, (p, r, fe, fl, e) in enumerate(own)]
    rows += [("a", 99, [], 0.1, 0.0, 1.0, False), ("unknown", 0, [dict(x=0.5, y=0.5)], 0.1, 0.0, 1.0, False)]
    df = spark.createDataFrame(rows, "frame string, stroke int, points array<struct<x:double,y:double>>, radius double, feather double, flow double, erase boolean")
    sizes = spark.createDataFrame([(f, w, h) for f, (w, h) in frames.items()], "frame string, width int, height int")
    got = {(r.frame, r.x, r.y): (r.alpha, r.beta) for r in coverage.stroke_coverage(df, sizes).collect()}
    for f, (w, h) in frames.items():
        alpha, beta = painted(strokes[f], w, h)
        for y in range(h):
            for x in range(w):
                assert got.pop((f, x, y), (1.0, 0.0)) == pytest.approx((alpha[y, x], beta[y, x]), abs=1e-12)
    assert not got


def test_means_and_clicks(spark):
    rng = np.random.default_rng(1)
    images = {1: rng.random((9, 150)), 2: rng.random((70, 66))}
    rows = [(f, x, y, float(g[y, x])) for f, g in images.items() for y in range(g.shape[0]) for x in range(g.shape[1]) if (x, y) != (5, 5)]
    df = spark.createDataFrame(rows, "frame int, x int, y int, g double")
    got = {(r.frame, r.x, r.y): r.g for r in coverage.around_means(df, ["g"]).collect()}
    assert len(got) == len(rows)
    for f, g in images.items():
        held = g.copy()
        held[5, 5] = np.nan
        for y in range(g.shape[0]):
            for x in range(g.shape[1]):
                if (x, y) != (5, 5):
                    assert got[f, x, y] == pytest.approx(np.nanmean(held[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]), abs=1e-12)
    sizes = spark.createDataFrame([(1, 150, 9), (2, 66, 70)], "frame int, width int, height int")
    clicks = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.5, 0.5), (2, 1.2, 0.0), (3, 0.5, 0.5), (2, None, 0.1)], "frame int, u double, v double")
    found = {(r.frame, r.u, r.v): (r.g, r.problem) for r in coverage.colours_at(df, sizes, clicks, ["g"]).collect()}
    assert found[1, 0.0, 1.0] == (pytest.approx(images[1][6:9, 0:3].mean()), None)
    assert found[2, 0.5, 0.5][1] is None and found[2, 0.5, 0.5][0] == pytest.approx(got[2, 33, 35])
    assert [found[k][1] for k in ((2, 1.2, 0.0), (3, 0.5, 0.5), (2, None, 0.1))] == ["outside the picture", "no such picture", "outside the picture"]


def shown(b, e, w, k):
    smooth = lambda lo, hi, x: (lambda t: t * t * (3 - 2 * t))(min(max((x - lo) / (hi - lo), 0), 1))
    x = (b + 0.5) / 256 * 2**e
    x *= 2 ** ((w * smooth(0.18, 1.0, x) + k * (1 - smooth(0.02, 0.18, x))) / 100)
    x = min(max(x, 0), 1)
    return 255 * (x * 12.92 if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055)


def half_up(x, digits):
    return math.floor(abs(x) * 10**digits + 0.5) / 10**digits * (1 if x >= 0 else -1)


def by_loop(histogram):
    """The sliders, from a percentile of the whole picture's display values at every step."""
    total = sum(histogram)
    if not total:
        return (None, None, None)

    def percentile(f, *sliders):
        values = sorted((shown(b, *sliders), n) for b, n in enumerate(histogram) if n)
        seen = 0
        for v, n in values:
            seen += n
            if seen >= max(1, math.ceil(total * f)):
                return v

    def search(lo, hi, small, digits):
        for _ in range(12):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if small(mid) else (lo, mid)
        return half_up((lo + hi) / 2, digits)

    now = percentile(0.5, 0, 0, 0)
    e = 0.0 if 95 <= now <= 135 else search(-2, 2, lambda m: percentile(0.5, m, 0, 0) < min(max(now, 95), 135), 2)
    if e > 0 and percentile(0.995, e, 0, 0) > 250:
        e = min(e, search(0, e, lambda m: percentile(0.995, m, 0, 0) < 250, 2))
    high = percentile(0.995, e, 0, 0)
    w = search(-50, 50, lambda m: percentile(0.995, e, m, 0) < (235 if high < 235 else 250), 1) if high < 235 or high >= 254 else 0.0
    low = percentile(0.005, e, w, 0)
    k = search(-50, 50, lambda m: percentile(0.005, e, w, m) < (20 if low > 20 else 5), 1) if low > 20 or low < 2 else 0.0
    return (e, w, k)


def test_auto_tone_equals_a_loop(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        middle, spread = rng.choice([3, 20, 50, 128, 230]), rng.choice([2, 10, 60])
        h = [0] * 256
        for _ in range(400):
            h[min(255, max(0, int(rng.gauss(middle, spread))))] += 1
        if i % 4 == 0:
            h[rng.choice([0, 255])] += 30
        rows.append((i, h))
    rows += [(100, [0] * 256), (101, [5] + [0] * 255), (102, [0] * 255 + [5])]
    got = fit.auto_tone(spark.createDataFrame(rows, "id int, histogram array<long>")).collect()
    for r in got:
        assert (r.exposure, r.whites, r.blacks) == pytest.approx(by_loop(dict(rows)[r.id]), abs=1e-9), r.id


def dense_fit(rows, iterations=8, start=None):
    """Gauss-Newton with numpy on all patches of a chart at once."""
    x, t, w = np.array([r[:3] for r in rows]), np.array([r[3:6] for r in rows]), np.array([r[6] for r in rows])
    m = np.eye(3) if start is None else start.copy()
    for _ in range(iterations):
        for c in range(3):
            y = np.maximum(x @ m[c], fit.LEAST)
            j = (y ** (-2 / 3) / 3)[:, None] * x
            off = np.cbrt(np.maximum(t[:, c], fit.LEAST)) - np.cbrt(y)
            a = j.T @ (w[:, None] * j) + fit.RIDGE * np.eye(3)
            m[c] = m[c] + np.linalg.solve(a, j.T @ (w * off) - fit.RIDGE * (m[c] - np.eye(3)[c]))
    return m


def test_colour_fit_and_leave_one_out(spark):
    rng = np.random.default_rng(3)
    rows, charts = [], {}
    for chart in "abc":
        true = np.eye(3) + rng.normal(0, 0.1, (3, 3))
        for i in range(24):
            c = rng.uniform(0.02, 0.9, 3)
            t = np.maximum(true @ c + rng.normal(0, 0.01, 3), 1e-3)
            charts.setdefault(chart, []).append((*map(float, c), *map(float, t), [2.0, 1.0, 0.25][i % 3]))
            rows.append((chart, i, *charts[chart][-1]))
    rows += [("d", 0, 0.1, None, 0.1, 0.1, 0.1, 0.1, 1.0), ("e", 0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5, None)]
    df = spark.createDataFrame(rows, "chart string, patch int, r double, g double, b double, target_r double, target_g double, target_b double, weight double")
    fitted = fit.fit_matrices(df)
    got = {r.chart: np.array(r.matrix).reshape(3, 3) for r in fitted.collect()}
    assert set(got) == {"a", "b", "c", "e"} and np.allclose(got["e"], np.eye(3))
    for chart, own in charts.items():
        assert np.allclose(got[chart], dense_fit(own), atol=1e-8)
    out = {(r.chart, r.patch): r.error for r in fit.leave_one_out(df, fitted).collect()}
    miss = lambda m, p: np.linalg.norm(np.cbrt(np.maximum(m @ np.array(p[:3]), fit.LEAST)) - np.cbrt(np.array(p[3:6])))
    far = []
    for chart, own in charts.items():
        for i in range(24):
            rest = own[:i] + own[i + 1 :]
            assert out[chart, i] == pytest.approx(miss(dense_fit(rest, 1, got[chart]), own[i]), abs=1e-8)
            far.append(abs(out[chart, i] - miss(dense_fit(rest), own[i])))
    assert np.median(far) < 2e-3 and np.quantile(far, 0.9) < 2e-2 and max(far) < 0.25  # against fits that are run again


@pytest.mark.parametrize("name", ["look_fit"])
def test_look_query(spark, name):
    got = catalog.QUERIES[name](spark, SF).collect()
    rows = {}
    for r in catalog.QUERIES["look_patches"](spark, SF).collect():
        rows.setdefault(r.chart, []).append((r.r, r.g, r.b, r.target_r, r.target_g, r.target_b, r.weight))
    assert {r.chart for r in got} == set(rows)
    for r in got:
        assert np.allclose(np.array(r.matrix), dense_fit(rows[r.chart]).ravel(), atol=1e-5)


def tables(spark, store):
    store.commit(items=spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, kind int"))


def plan_of(store):
    return Plan.of(store.read("items"), F.when(F.col("kind") == 0, "kept"))


def effect(store, plan):
    return {"items": plan.skipped.drop("reason")}


def test_apply_only_what_was_seen(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    tables(spark, store)
    seen = tuple(plan_of(store).fingerprint(["id", "kind"]).first())
    store.commit(items=store.read("items").unionAll(spark.createDataFrame([(50, 1)], "id long, kind int")))
    before = sorted(p.name for p in (tmp_path / "manifests").iterdir())
    with pytest.raises(PlanMoved, match="6 actions, now it has 7"):
        store.apply(plan_of, seen, ["id", "kind"], effect)
    assert sorted(p.name for p in (tmp_path / "manifests").iterdir()) == before and store.read("items").count() == 10
    again = tuple(plan_of(store).fingerprint(["id", "kind"]).first())
    store.apply(plan_of, again, ["id", "kind"], effect)
    assert sorted(r.id for r in store.read("items").collect()) == [0, 3, 6]
    with pytest.raises(PlanMoved):
        store.apply(plan_of, again, ["id", "kind"], effect)


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    tables(spark, store)
    seen = tuple(plan_of(store).fingerprint(["id", "kind"]).first())
    meet, results = threading.Barrier(2), []

    def write(name):
        def slow(s, plan):
            meet.wait(60)  # both have checked the plan by now
            return effect(s, plan) | {name: s.read("items")}

        try:
            Snapshots(spark, str(tmp_path)).apply(plan_of, seen, ["id", "kind"], slow)
            results.append(name)
        except PlanMoved:
            results.append(None)

    both = [threading.Thread(target=write, args=(n,)) for n in ("one", "two")]
    [t.start() for t in both]
    [t.join() for t in both]
    won = [r for r in results if r]
    assert len(won) == 1 and store.version() == 1
    assert set(store.current()) == {"items", won[0]} and store.read("items").count() == 3
    assert len([p for p in tmp_path.iterdir() if p.name != "manifests"]) == 2  # the refused one's folder is gone
