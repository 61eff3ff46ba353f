"""Secret scan: fixed patterns, and a randomness test battery under false-discovery control.

Base patterns are matched leftmost and without overlap; a match's position is
the length of what `split` leaves before it plus the matches before it, so all
of it stays in built-in functions.

The method adds spans. Every run of `least`+ token characters is a candidate;
its encoding (hex, base32, base64, base64url, or one case of letters) is
inferred from the characters it holds. Against uniform draws from that alphabet
it takes three tests: chi-squared evenness of its symbols (Wilson-Hilferty), runs
above and below the alphabet's middle, and lag-one serial correlation. Its
p-value is three times the least of the three.

False discoveries are controlled twice, with Benjamini-Hochberg thresholds by
stratum, for candidates of like length, so that the many short words do not
decide for the few long tokens. First the battery: whatever it finds not to be
uniform, at `alpha`, is out. Passing is not enough, though: a short word is not
uneven either. So what passed has a p-value for "ordinary word", the least of two
length-aware bounds, doubled, and those below the threshold at `fdr` are found;
what the battery threw out counts as tested, with a p-value of 1. One bound is
the chance that letters with the collision rate of running text repeat as seldom;
the other is a Chernoff bound on so many changes between lower case, upper case,
digits and signs. P-values are rounded up to steps of a tenth of a decade, which
makes the thresholds a matter of at most 4 x 4001 counts each: those are all that
reaches the driver. Copies count as often as they occur. Fewer than `least`
symbols are not tested: of an alphabet of 64 nearly all would be different in
ordinary names too, and neither bound can fall below such a threshold.

The whole texts are read once; what is kept is a row per text with its spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, text_of

#: Base kinds in order and their patterns. A run of access or hex characters is matched whole, so its
#: least length can stand in the pattern; an assignment's value is measured after the match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABETS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 16, "0123456789abcdef"),
    ("letters", r"^([a-z]+|[A-Z]+)$", 26, "abcdefghijklmnopqrstuvwxyz"),
    ("base32", r"^[A-Z2-7]+$", 32, "abcdefghijklmnopqrstuvwxyz234567"),
    ("base64", r"^[A-Za-z0-9+/]+$", 64, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", 64, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
STRATA = (32, 48, 64)
STEPS = 4000
SURE = 60  # a battery's threshold lies at alpha times the share that it rejects; below a millionth of alpha nothing is left open
#: Of running text: chance that two letters agree, that three do, and that neighbours differ in class.
COLLIDE, COLLIDE3, CHANGE = 0.066, 0.0056, 0.12


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of the pattern's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
    ends = _running(F.zip_with(found, gaps, lambda m, g: g + F.length(m)))
    placed = F.zip_with(found, ends, lambda m, b: F.struct((b - F.length(m)).alias("start"), b.alias("end"), m.alias("match")))
    return F.when(F.size(found) > 0, placed).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def _running(values: Column, run: int = 256) -> Column:
    """Running sums of an array. An array grows by copying, so sums run within pieces, and over the pieces' totals."""

    def grow(xs: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")), lambda acc: acc["out"])

    def pieced(xs: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / run).cast("int")), lambda k: F.slice(xs, k * run + 1, run))
        totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(pieces, F.zip_with(grow(totals, F.lit(0)), totals, lambda a, t: a - t), grow))

    return _let(values, lambda xs: F.when(F.size(xs) > run, pieced(xs)).otherwise(grow(xs, F.lit(0))))


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal; Abramowitz and Stegun 26.2.17, and its leading term far out."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))


def _counts(chars: Column, whole: Column) -> Column:
    """How often each different character of chars occurs in the string whole."""
    return F.transform(F.array_distinct(chars), lambda c: (F.length(whole) - F.length(F.replace(whole, c, F.lit("")))).cast("double"))


def _chars(token: Column) -> Column:
    return F.regexp_extract_all(token, F.lit("."), F.lit(0))


def _uniform(token: Column, kind: Column) -> Column:
    """p-value of the three tests against uniform draws from the encoding's alphabet."""
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), kind + 1)
    facts = F.struct(
        F.when(kind < 3, F.lower(token)).otherwise(token).alias("read"),
        pick([float(a[2]) for a in ALPHABETS]).alias("k"),
        pick([a[3] for a in ALPHABETS]).alias("letters"),
        F.length(token).cast("double").alias("n"),
    )

    def with_places(f: Column) -> Column:
        at = F.struct(*(f[x].alias(x) for x in ("read", "k", "n")), F.transform(_chars(f["read"]), lambda c: (F.instr(f["letters"], c) - 1).cast("double")).alias("places"))
        return _let(at, with_sums)

    def with_sums(f: Column) -> Column:
        places, last = f["places"], F.size(f["places"]) - 1
        pairs = F.zip_with(F.slice(places, F.lit(1), last), F.slice(places, F.lit(2), last), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        sums = F.struct(
            f["k"].alias("k"),
            f["n"].alias("n"),
            places.alias("places"),
            pairs.alias("pairs"),
            (_sum(places) / f["n"]).alias("centre"),
            _sum(places, lambda x: F.when(x >= f["k"] / 2, 1.0).otherwise(0.0)).alias("ups"),
            _sum(_counts(_chars(f["read"]), f["read"]), lambda c: c * c).alias("square"),
        )
        return _let(sums, tests)

    def tests(f: Column) -> Column:
        n, k, half, centre = f["n"], f["k"], f["k"] / 2, f["centre"]
        df = k - 1
        z_chi = (F.pow((k / n * f["square"] - n) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        turns = 1 + _sum(f["pairs"], lambda p: F.when((p["a"] >= half) != (p["b"] >= half), 1.0).otherwise(0.0))
        mean = 2 * f["ups"] * (n - f["ups"]) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(spread > 0, 2 * _normal_tail(F.abs(turns - mean) / F.sqrt(spread))).otherwise(0.0)
        variance = _sum(f["places"], lambda x: (x - centre) * (x - centre))
        covariance = _sum(f["pairs"], lambda p: (p["a"] - centre) * (p["b"] - centre))
        serial = F.when(variance > 0, 2 * _normal_tail(F.abs(covariance / variance + 1 / n) * F.sqrt(n))).otherwise(0.0)
        return F.least(F.lit(1.0), 3 * F.least(_normal_tail(z_chi), runs, serial))

    return _let(facts, with_places)


def _ordinary(token: Column) -> Column:
    """p-value against an ordinary word of the same length."""
    classes = F.translate(token, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    lower = F.lower(token)
    facts = F.struct(
        F.length(token).cast("double").alias("n"),
        _sum(_counts(_chars(lower), lower), lambda c: c * (c - 1)).alias("agree"),
        (F.length(F.regexp_replace(classes, r"(.)\1*", "$1")) - 1).cast("double").alias("changes"),
    )

    def bound(f: Column) -> Column:
        n = f["n"]
        sd = F.sqrt(2 * n * (n - 1) * (COLLIDE - COLLIDE**2) + 4 * n * (n - 1) * (n - 2) * (COLLIDE3 - COLLIDE**2))
        even = _normal_tail((n * (n - 1) * COLLIDE - f["agree"]) / sd)
        rate = F.least(f["changes"] / (n - 1), F.lit(1 - 1e-9))
        kl = rate * F.log(rate / CHANGE) + (1 - rate) * F.log((1 - rate) / (1 - CHANGE))
        return F.least(F.lit(1.0), 2 * F.least(even, F.when(rate > CHANGE, F.exp(-(n - 1) * kl)).otherwise(1.0)))

    return _let(facts, bound)


def _steps(token: Column, alpha: float) -> Column:
    """struct<uneven, step>: tenths of decades of the battery's p-value and of that against an ordinary word; null without an encoding.

    A p-value of the battery that no threshold at alpha can accept leaves no step to compute.
    """
    kind = F.coalesce(*(F.when(token.rlike(p), F.lit(i)) for i, (_, p, _, _) in enumerate(ALPHABETS)))
    tenths = lambda p: F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(STEPS)).cast("int")
    sure = math.floor(-10 * math.log10(alpha)) + SURE
    tested = lambda u: F.struct(u.alias("uneven"), F.when(u < sure, tenths(_ordinary(token))).otherwise(F.lit(0)).alias("step"))
    return F.when(kind.isNotNull() & ~token.rlike("^[0-9]+$"), _let(tenths(_uniform(token, kind)), tested))


def _stratum(n: Column) -> Column:
    return sum((F.when(n >= edge, 1).otherwise(0) for edge in STRATA), F.lit(0))


def thresholds(counts: dict[tuple[int, int], int], fdr: float) -> list[int]:
    """Least step that each stratum's Benjamini-Hochberg rule accepts; STEPS + 1 if none. counts: by (stratum, step)."""
    out = []
    for s in range(len(STRATA) + 1):
        m = sum(n for (a, _), n in counts.items() if a == s)
        running, best = 0, STEPS + 1
        for step in range(STEPS, -1, -1):
            running += counts.get((s, step), 0)
            if running and 10 ** (-step / 10) <= fdr * running / m:
                best = step
        out.append(best)
    return out


def _below(values: Column, marks: Column) -> Column:
    """For each of ascending marks, how many of the values are below it: its place in the sorted union less the marks before it."""
    merged = F.sort_array(F.concat(F.transform(values, lambda v: v * 2 + 1), F.transform(marks, lambda m: m * 2)))
    at = F.array_remove(F.transform(merged, lambda v, p: F.when(v % 2 == 0, p).otherwise(-1)), -1)
    return F.transform(at, lambda p, i: p - i)


def _clear_of(runs: Column, base: Column) -> Column:
    """Runs (ascending, apart from each other) that overlap no base span: as many spans have ended before a run as have begun before its end."""
    begun = _below(F.transform(base, lambda b: b["start"]), F.transform(runs, lambda r: r["end"]))
    ended = _below(F.transform(base, lambda b: b["end"]), F.transform(runs, lambda r: r["start"] + 1))
    return _let(F.struct(begun.alias("begun"), ended.alias("ended")), lambda n: F.filter(runs, lambda r, i: F.get(n["begun"], i) == F.get(n["ended"], i)))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 20, alpha: float = 1e-3, fdr: float = 0.01) -> DataFrame:
    """One row per row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans, n_random, found.

    found holds the spans as structs (start, kind, end), spans the same as text.
    Positions count code points, end exclusive. A null or empty text has no
    spans. A span of the method is left out where it overlaps a base span.
    Equal rows get equal results; other columns of docs are ignored, and an
    empty table gives an empty result.
    """
    text = text_of(text_col)
    assign = F.filter(_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6)
    access, hexes = _spans(text, ACCESS), _spans(text, HEX)
    runs = _spans(text, rf"[A-Za-z0-9+/_-]{{{least},}}={{0,2}}")
    base = F.array_sort(F.concat(_tagged(assign, 0), _tagged(access, 1), _tagged(hexes, 2)))
    rows = docs.select(F.col(id_col).alias("id"), base.alias("base"), runs.alias("runs"))
    rows = rows.select("id", "base", _clear_of(F.col("runs"), F.col("base")).alias("runs"))

    def tested(r: Column) -> Column:
        steps = _let(F.regexp_replace(r["match"], "=+$", ""), lambda token: _steps(token, alpha))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), _stratum(r["end"] - r["start"]).alias("stratum"), steps.alias("steps"))

    scanned = stage(rows.select("id", "base", F.filter(F.transform("runs", tested), lambda c: c["steps"].isNotNull()).alias("tests")), "secret-spans")
    every = scanned.select(F.inline("tests")).select("stratum", "steps.uneven", "steps.step")

    def limits(rows: DataFrame, level: float) -> Column:
        counts = {(r["stratum"], r["step"]): r["count"] for r in rows.groupBy("stratum", "step").count().collect()}
        return F.array(*(F.lit(c) for c in thresholds(counts, level)))

    out_at = limits(every.select("stratum", F.col("uneven").alias("step")), alpha)
    passes = lambda stratum, uneven: uneven < F.element_at(out_at, stratum + 1)
    found_at = limits(every.select("stratum", F.when(passes(F.col("stratum"), F.col("uneven")), F.col("step")).otherwise(0).alias("step")), fdr)
    is_found = lambda c: passes(c["stratum"], c["steps"]["uneven"]) & (c["steps"]["step"] >= F.element_at(found_at, c["stratum"] + 1))
    added = F.transform(F.filter("tests", is_found), lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    names = F.array(*(F.lit(k) for k in KINDS))

    def written(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    out = scanned.withColumn("found", F.array_sort(F.concat("base", added)))
    return out.select(
        F.col("id").alias(id_col),
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
        (F.size("found") - F.size("base")).cast("long").alias("n_random"),
        F.transform("found", lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end"))).alias("found"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_secrets of all documents with production parameters; null texts count as empty."""
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("found")
