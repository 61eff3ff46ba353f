"""Results that SQL cannot express, held against plain Python."""

import collections
import math
import random
import re

import numpy as np
import pytest
from helpers import low
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, license_scan, mixing, pieces, secret_scan


def tail(z):
    x = min(abs(z), 37.0)
    t = 1 / (1 + 0.2316419 * x)
    p = math.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return p if z >= 0 else 1 - p


def battery(token, k, letters):
    """Least of three p-values against uniform draws, times three."""
    at, n = [letters.index(c) for c in token], len(token)
    chi = k / n * sum(c * c for c in collections.Counter(token).values()) - n
    df = k - 1
    p_chi = tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [a >= k / 2 for a in at]
    runs, ups = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), sum(high)
    mean = 2 * ups * (n - ups) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = 2 * tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    c = sum(at) / n
    ss = sum((a - c) ** 2 for a in at)
    p_serial = 2 * tail(abs(sum((a - c) * (b - c) for a, b in zip(at, at[1:], strict=False)) / ss + 1 / n) * math.sqrt(n)) if ss else 0.0
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def ordinary(token):
    n, c2, c3, change = len(token), secret_scan.COLLIDE, secret_scan.COLLIDE3, secret_scan.CHANGE
    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
    kinds = [kind(c) for c in token]
    agree = sum(c * (c - 1) for c in collections.Counter(token.lower()).values())
    sd = math.sqrt(2 * n * (n - 1) * (c2 - c2**2) + 4 * n * (n - 1) * (n - 2) * (c3 - c2**2))
    even = tail((n * (n - 1) * c2 - agree) / sd)
    rate = min(sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (n - 1), 1 - 1e-9)
    chernoff = math.exp(-(n - 1) * (rate * math.log(rate / change) + (1 - rate) * math.log((1 - rate) / (1 - change)))) if rate > change else 1.0
    return min(1.0, 2 * min(even, chernoff))


def accepted(tests, level):
    """Largest p-value that Benjamini and Hochberg accept in each stratum of (stratum, p); nothing: -1."""
    out = {}
    for s in {s for s, _ in tests}:
        ps = sorted(p for q, p in tests if q == s)
        out[s] = max((p for i, p in enumerate(ps) if p <= level * sum(x <= p for x in ps) / len(ps)), default=-1)
    return out


def found_secrets(texts, alpha=1e-3, fdr=0.01):
    up = lambda p: 10 ** (-min(secret_scan.STEPS, math.floor(-10 * math.log10(max(p, 1e-300)))) / 10)
    rows = []
    for i, t in enumerate(texts):
        base = [m.span() for m in re.finditer(secret_scan.ASSIGN, t) if len(m.group(2)) >= 6]
        base += [m.span() for p in (secret_scan.ACCESS, secret_scan.HEX) for m in re.finditer(p, t)]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", t):
            a, b = m.span()
            token = m.group().rstrip("=")
            names = [k for k, (_, p, _, _) in enumerate(secret_scan.ALPHABETS) if re.search(p, token)]
            if any(x < b and a < y for x, y in base) or not names or token.isdigit():
                continue
            _, _, k, letters = secret_scan.ALPHABETS[names[0]]
            stratum = sum(b - a >= e for e in secret_scan.STRATA)
            rows.append((i, a, b, stratum, up(battery(token.lower() if names[0] < 3 else token, k, letters)), up(ordinary(token))))
    uneven = accepted([(s, p) for *_, s, p, _ in rows], alpha)
    plain = [(s, 1.0 if u <= uneven[s] else p) for *_, s, u, p in rows]
    limit = accepted(plain, fdr)
    return {(i, a, b) for (i, a, b, s, *_), (_, p) in zip(rows, plain, strict=True) if p <= limit[s]}


def test_secrets_of_the_battery(spark):
    rng = random.Random(4)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    b64, hexes = secret_scan.ALPHABETS[3][3], "0123456789ABCDEF"
    texts = []
    for i in range(400):
        words = ["".join(rng.choice(["ver", "bin", "dung", "schrift", "lich", "keit", "ein"]) for _ in range(6)) for _ in range(2)]
        odd = [draw(b64, 40), draw(hexes, 40), draw("abcdefghijklmnopqrstuvwxyz", 44), "a" * 30, "abcdefgh" * 4, draw(b64, 24), "snake_case_identifier_of_a_test", draw(b64, 70) + "=="][i % 8]
        texts.append(" ".join([words[0], odd, words[1], f"token: {draw(b64, 20)}" if i % 5 == 0 else ""]))
    got = secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {(r["doc_id"], s["start"], s["end"]) for r in got for s in r["found"] if s["kind"] == "random"}
    want = found_secrets(texts)
    assert spans == want and len(want) > 100
    assert not any(set(texts[i][a:b]) == {"a"} for i, a, b in spans)


def test_positions_of_very_many_matches(spark):
    """More matches in one text than one piece of running sums holds, some of them far apart."""
    text = " ".join(f"é{'é' * (k % 7)} {k % 10}{'0123456789abcdef' * 2}" for k in range(3000))
    r = secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["start"], s["end"]) for s in r["found"] if s["kind"] == "hex"] == [m.span() for m in re.finditer(secret_scan.HEX, text)]


def test_naive_bayes(spark):
    rng = random.Random(2)
    letters = {"xx": "abcde fg", "yy": "efghi jk", "zz": "äöü abc"}
    rows = [(i, "".join(rng.choice(letters[k]) for _ in range(30)), k) for i in range(60) for k in [sorted(letters)[i % 3]]]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(text):
        c = "".join(x if x.isalpha() else " " for x in text.lower())
        return [c[i : i + n] for n in (2, 3) for i in range(len(c) - n + 1) if c[i : i + n].strip()]

    bucket = {g: int([f for _, f in langid.features([g])][len(g) - 2][-1]) for _, t, _ in rows for g in grams(t)}
    counts = {k: collections.Counter(bucket[g] for _, t, x in rows if x == k for g in grams(t)) for k in letters}
    held = [(i, "".join(rng.choice(letters[k]) for _ in range(12))) for i, k in enumerate(["xx", "yy", "zz"] * 5)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(held, "doc_id long, text string"), model).collect()}
    for i, t in held:
        at = [int([f for _, f in langid.features([g])][len(g) - 2][-1]) for g in grams(t)]
        logs = {k: math.log(1 / 3) + sum(math.log(c[b] + 1) - math.log(sum(c.values()) + langid.BUCKETS) for b in at) for k, c in counts.items()}
        best = max(logs, key=logs.get)
        assert got[i][0] == best and abs(got[i][1] - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-3


@pytest.mark.parametrize("weights", [False, True])
def test_copies_of_a_mix(spark, weights):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 200)), rng.choice(["a", "a", "a", "b", "c"]), rng.choice([0.5, 1.0, 3.0])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    how = {"weight_col": "weight"} if weights else {}
    got = {r["doc_id"]: (r["copies"], r["target"]) for r in mixing.mix_sources(docs, bins=16, **how).collect()}
    salts = {r["__id"]: r["__salt"] for r in mixing._measured(docs, "doc_id", "text", "source", None, 7, []).collect()}  # noqa: SLF001
    target = {s: got[next(i for i, _, x, _ in rows if x == s)][1] for s in "abc"}
    for s in "abc":
        mine = [(i, len(t.split()), w if weights else 1.0) for i, t, x, w in rows if x == s]
        total = sum(n * w for _, n, w in mine)
        whole, ranks = {}, []
        for i, n, w in mine:
            expected = min(3.0, target[s] / total * w)
            whole[i] = math.floor(expected)
            part = expected - whole[i]
            u = ((salts[i] % 2**64 >> 11) + 0.5) / 2**53
            if part > 0:
                ranks.append(((u / (1 - u)) / (part / (1 - part)), i, n))
        rest = target[s] - sum(n * whole[i] for i, n, _ in mine)
        for _ in range(2):
            taken, ranks_left = 0, []
            open_ = True
            for r in sorted(ranks):
                open_ = open_ and taken + r[2] / 2 <= rest
                if open_:
                    whole[r[1]] += 1
                    taken += r[2]
                else:
                    ranks_left.append(r)
            rest -= taken
            ranks = [r for r in ranks_left if r[2] <= rest] if rest > 0 else []
        assert {i: got[i][0] for i, _, _ in mine} == whole


def licence_labels(texts, rare_words=6):
    """Labels and score of each text, every alignment tried."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    words = [split(t) for t in texts]
    vocab = {w for _, t, _ in license_scan.TEMPLATES for w in t.split()} | {w for p, _ in license_scan.BASE_PHRASES for w in p.split()}
    df = {w: sum(w in set(x) for x in words) for w in vocab}
    number = {w: int(license_scan._hashes(w)[0]) for w in vocab}  # noqa: SLF001  ties go by hash
    has = lambda w, p: any(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1))
    out = []
    for w in words:
        labels = {label for p, label in license_scan.BASE_PHRASES if has(w, p.split())}
        score = 1.0 if labels else 0.0
        for label, text, phrases in license_scan.TEMPLATES:
            seq = text.split()
            indexed = sorted(set(seq), key=lambda x: (df[x] == 0, df[x], number[x]))[: 2 * rare_words]
            rare = set(sorted(set(indexed) & set(w), key=lambda x: (df[x], number[x]))[:rare_words])
            for at in range(-len(seq) + 1, len(w)):
                lo, hi = max(0, at), min(len(w), at + len(seq))
                same = [w[k] for k in range(lo, hi) if w[k] == seq[k - at]]
                if len(rare & set(same)) >= 2 and all(has(w[lo:hi], p.split()) for p in phrases):
                    labels.add(label)
                    score = max(score, len(same) / len(seq))
        out.append((",".join(sorted(labels)), round(score, 9)))
    return out


def test_licence_labels(spark):
    rng = random.Random(8)
    filler = "the of and to software any license use copy public or without code this free".split()
    texts = []
    for k, (_, notice, _) in enumerate(license_scan.TEMPLATES):
        w = notice.split()
        cut = w[: max(4, len(w) - rng.randrange(len(w)))]
        changed = [x if rng.random() > 0.1 else "other" for x in w]
        for body in (w, cut, changed):
            texts.append(" ".join([rng.choice(filler) for _ in range(rng.randrange(30))] + [x.title() if k % 2 else x for x in body] + [rng.choice(filler) for _ in range(rng.randrange(30))]))
    texts += [" ".join(rng.choice(filler) for _ in range(200)) for _ in range(5)] + ["without restriction permission is hereby granted"]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["labels"], round(r["score"], 9)) for r in got] == licence_labels(texts)
    assert len({r["labels"] for r in got}) > 10


def test_pipeline_keeps_columns_that_are_named_like_results(spark):
    rows = [(i, f"the quick brown fox jumps over the lazy dog number {i} and runs away from it", "en", "s", 50, float(-i), "mine", i, True) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, gone_id long, kept boolean")
    for name, work in corpus_pipeline.STAGES[:-1]:
        out = work(spark, docs, "")
        assert out.columns == docs.columns, name
        assert {(r["doc_id"], r["score"], r["lang_pred"], r["gone_id"]) for r in out.collect()} <= {(i, float(-i), "mine", i) for i in range(6)}, name
    assert corpus_pipeline.keep_known_languages(spark, docs, "").count() == 6
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, docs.limit(0), "").count() == 0


@pytest.fixture(scope="module")
def encoder():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Encoder(pieces.load(f.read()), 0.1, 3)


def test_a_word_has_ever_more_segmentations(encoder):
    rng = np.random.default_rng(1)
    salts = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    ids, ends = encoder.encode_texts(["understanding"] * 20_000, salts)
    assert len({ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)}) > 100


@pytest.mark.parametrize("segment", [7, 64, 1000])
def test_segments_change_nothing(encoder, monkeypatch, segment):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["understanding", "a", "", "réseau", "x" * 90]) for _ in range(80)), " " * 500 + "end", "", "no spaces" + "y" * 300]
    salts = np.arange(4, dtype=np.uint64)
    want = [x.tolist() for x in encoder.encode_texts(texts, salts)]
    monkeypatch.setattr(pieces, "SEGMENT", segment)
    assert [x.tolist() for x in encoder.encode_texts(texts, salts)] == want


def test_extra_columns_do_not_matter(spark, docs):
    plain = docs.select("doc_id", "text")
    for scan in (secret_scan.scan_secrets, license_scan.scan_licenses):
        a, b = (scan(d).orderBy(F.col("doc_id"), F.hash(*scan(plain).columns[1:3])).collect() for d in (docs, plain))
        assert sorted(map(str, a)) == sorted(map(str, b))
