"""Spans of texts with very many matches: the same as pair by pair, in time that grows with the text."""

import random
import time

from pyspark.sql import functions as F

from tidemark.llm import secret_scan as S


def test_runs_clear_of_base_spans(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        cuts = sorted(rng.sample(range(300), 2 * rng.randrange(0, 20)))
        runs = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        base = sorted((a, a + rng.randrange(1, 30)) for a in (rng.randrange(300) for _ in range(rng.randrange(0, 20))))
        rows.append((runs, base))
    df = spark.createDataFrame(rows, "runs array<struct<start:int,end:int>>, base array<struct<start:int,end:int>>")
    for r in df.select("*", S._clear_of(F.col("runs"), F.col("base")).alias("clear")).collect():
        assert [tuple(x) for x in r.clear] == [(a, b) for a, b in r.runs if not any(c < b and a < d for c, d in r.base)]


def test_time_grows_with_the_text(spark):
    rng = random.Random(2)
    part = lambda: f"password = {rng.getrandbits(60):x} and {''.join(rng.choice('abcdefghij0123456789KLMNOPQR') for _ in range(30))} then "
    text = "".join(part() for _ in range(13_000))  # about 1 MB with 26,000 spans
    scan = lambda n: S.scan_secrets(spark.createDataFrame([(1, text[:n])], "doc_id long, text string")).select("n_assign", "n_random").first()
    scan(20_000)  # code is compiled
    took = []
    for n in (250_000, 1_000_000):
        began = time.time()
        found = scan(n)
        took.append(time.time() - began)
    assert found.n_assign > 11_000 and found.n_random > 11_000
    assert took[1] < 8 * took[0] + 5
