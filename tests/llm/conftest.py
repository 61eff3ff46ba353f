import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source): copies, near copies, shared passages, nulls, blanks, odd scripts, long words."""
    base = prose(1, 120)
    passage = prose(2, 40)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), base.upper(), None, "", " \t\n", "one two three", "One TWO three", "x", "é", "日本語 のテキスト 😀",
        prose(3, 30) + " " + passage + " " + prose(4, 30), passage + " " + prose(5, 50), prose(6, 20) + "\n" + passage, "w" * 3000 + " " + prose(7, 20),
        prose(8, 2000), " ".join(["again"] * 60), "again " * 60, "a b c▁d\x00e",
    ]
    rows = [(i * 3 % 50, t, ["en", "de", None][i % 3], [None, "s1", "s2"][i % 3]) for i, t in enumerate(texts)]
    return rows + [(7, "a row with no like", "en", "s1"), (7, base, "en", "s1"), (None, base, "en", "s1"), (rows[0][0], base, "en", "s1")]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with results."""
    extra = "kept boolean, score double, id long, key long, size long, target double, rank long, block long, ids array<int>, spans string"
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *(f"CAST(NULL AS {t}) AS {n}" for n, t in (c.split(" ", 1) for c in extra.split(", "))))
