"""Exact, substring, near and embedding duplicates against plain Python."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import Union, kept_words, shingles
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, exact_dedup, graph, ngram_join, substring_dedup
from tidemark.llm.words import pieces, words_of


def listed(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_exact(spark, docs, corpus):
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in corpus), key=repr)
    got = exact_dedup.exact_dedup(docs, capacity=2).collect()
    assert listed(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in left.collect()) == sorted({x[4] for x in want})
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [2, 50])
def test_a_directory_doubles_until_its_buckets_fit(spark, capacity):
    rng = random.Random(capacity)
    near = 5 << 55  # neighbours share their first bits
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(40)] + [near, near + (1 << 53), near + (1 << 54), -1]
    got = {r["key"]: r["bucket"] for r in exact_dedup.directory(spark.createDataFrame([(k, 1) for k in keys], "key long, n int"), capacity).collect()}
    assert set(got) == set(keys)
    groups = collections.Counter(got.values())
    assert max(groups.values()) <= capacity and (capacity < 50 or len(groups) == 1)
    in_order = sorted(keys)
    assert [got[k] for k in in_order] == sorted(got.values())  # buckets are ranges


def test_chains_keep_texts_under_one_key_apart(spark, monkeypatch):
    """With a hash that says the same of all texts, links of one chain are told apart by their bytes."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, None), (6, "")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs).collect()
    assert listed(got, "doc_id", "keep_id", "group_size") == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1), (5, 6, 2), (6, 6, 2)]


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings(spark, docs, corpus, batches):
    rows = [(i, t) for i, t, *_ in corpus]
    got = substring_dedup.remove_repeats(docs, batches=batches, block_bytes=600).collect()
    assert listed(got, "doc_id", "n_words", "n_removed", "kept") == sorted(kept_words(rows), key=repr)


def test_substrings_of_random_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=300).collect()
    assert listed(got, "doc_id", "n_words", "n_removed", "kept") == sorted(kept_words(rows), key=repr)
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substrings_of_batches_that_come_one_by_one(spark, docs, corpus, tmp_path):
    """Three batches in separate calls, the last to an index that is opened again; larger and smaller ids in any order."""
    rows = [(i, t) for i, t, *_ in corpus]
    parts = [rows[0::3], rows[1::3], rows[2::3]]
    table = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"), block_bytes=600)
    for n, part in enumerate(parts):
        if n == 2:
            substring_dedup.FingerprintIndex(spark, str(tmp_path / "index")).blocks.append(table([(1, "left by a batch that failed " * 20)]), "doc_id", "text")
            index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"))
        index.add(table(part))
        got = index.results().collect() if n != 1 else []
        want = kept_words([r for p in parts[: n + 1] for r in p])
        assert n == 1 or listed(got, "id", "n_words", "n_removed", "kept") == sorted(want, key=repr)
    assert index.marks and (tmp_path / "index").exists()
    index.drop()
    assert not (tmp_path / "index").exists()


def components_of(rows):
    """component_id by row of (id, text), linking rows whose sets are alike."""
    u, sets = Union(), [shingles(t) for _, t in rows]
    for a, (i, _) in enumerate(rows):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and i is not None and rows[b][0] is not None and 100 * len(x & y) >= 80 * len(x | y):
                u.join(a, b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[u.root(a)] = min(least.get(u.root(a), i), i)
    return sorted(((i, len(s), least[u.root(a)] if i is not None else None) for a, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("part", [512, 3])
def test_near_copies(spark, docs, corpus, part):
    got = ngram_join.link_documents(docs, part=part, block_bytes=900).collect()
    assert listed(got, "doc_id", "n_shingles", "component_id") == components_of([(i, t) for i, t, *_ in corpus])


@pytest.mark.parametrize("part", [512, 5])
def test_chains_of_near_copies(spark, part):
    rng = random.Random(9)
    rows, text = [], [f"w{k}" for k in range(100)]
    for i in range(40):
        text = list(text)
        text[rng.randrange(100)] = f"c{i}"
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), part=part).collect()
    assert listed(got, "doc_id", "n_shingles", "component_id") == components_of(rows)
    assert ngram_join.link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_t_occurrence_counts_what_short_and_long_lists_hold():
    rng = random.Random(1)
    for _ in range(50):
        lists = [np.array(sorted(rng.sample(range(30), rng.randrange(1, 30)))) for _ in range(12)]
        t = rng.randrange(1, 12)
        found, count = ngram_join.t_occurrence(t, lists)
        full = np.bincount(np.concatenate(lists), minlength=30)
        assert found.tolist() == np.flatnonzero(full >= t).tolist() and count.tolist() == full[full >= t].tolist()


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 30)] + [(3, 3), (None, 4), (29, 500)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).select("node", "component").collect())
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in (*range(7, 30), 500)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.11, size=16)).tolist()) for i in range(150)]
    rows += [(1000 + k, rows[0][1]) for k in range(5)] + [(rows[3][0], rows[3][1])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [math.nan] * 16), (2004, [math.inf] + [0.0] * 15), (2005, [None] * 16), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, rows[1][1])]
    rows += [(3000, [1e-300] * 16), (3001, [1e300] * 16)]
    return rows


@pytest.mark.parametrize("block", [4096, 20])
def test_embeddings(spark, block):
    rows = vectors()
    ok = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for _, v in rows]
    unit = [np.array(v) / np.max(np.abs(v)) if g else None for (_, v), g in zip(rows, ok, strict=True)]
    unit = [x / np.linalg.norm(x) if x is not None else None for x in unit]
    u, n = Union(), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                n[a], n[b] = n[a] + 1, n[b] + 1
                u.join(a, b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[u.root(a)] = min(least.get(u.root(a), i), i)
    want = sorted(((i, n[a], least.get(u.root(a))) for a, (i, _) in enumerate(rows)), key=repr)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(1)).withColumn("rep", F.lit(2))
    got = embedding_dedup.link_embeddings(df, block=block).collect()
    assert listed(got, "vec_id", "n_links", "component_id") == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embedding_dedup.link_embeddings(df.limit(0)).count() == 0


def test_words_are_cut_and_hashed_alike_wherever_they_stand():
    import pyarrow as pa

    from tidemark.llm import words as w

    texts = ["a bc\td\x0b\x0ce", None, "", " bc ", "x" * 50, "é bc", "bc"]
    got = words_of(pa.array(texts))
    cut = [got.data[a:b].tobytes().decode() for a, b in zip(got.start, got.end, strict=True)]
    assert cut == ["a", "bc", "d", "e", "bc", "x" * 50, "é", "bc", "bc"]
    hashes = collections.defaultdict(set)
    for t, h in zip(cut, got.hash.tolist(), strict=True):
        hashes[t].add(h)
    assert all(len(x) == 1 for x in hashes.values()) and len({*got.hash.tolist()}) == len(hashes)
    old, w.BLOCK_BYTES, w._POWERS = w.BLOCK_BYTES, 7, None  # noqa: SLF001
    try:
        assert words_of(pa.array(texts)).hash[1] == words_of(pa.array(["bc"])).hash[0]
        assert words_of(pa.array(["y " + "x" * 50])).hash[1] == words_of(pa.array(["x" * 50])).hash[0]
    finally:
        w.BLOCK_BYTES, w._POWERS = old, None  # noqa: SLF001
    table = pa.table({"t": texts})
    assert sum(len(p) for p in pieces(table, "t", 3)) == len(texts)


def alike(letters=10):
    """Two words that every polynomial with an odd base takes for one, modulo 2**64."""
    word = "a"
    for _ in range(letters):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("letters", [5, 6, 9, 10, 12])
def test_words_that_polynomials_take_for_one(spark, letters):
    a, b = alike(letters)
    w = words_of(pa.array([a, b, a]))
    assert w.hash[0] != w.hash[1] and w.hash[0] == w.hash[2]
    assert w.second()[0] != w.second()[1] and w.second()[0] == w.second()[2] != w.hash[0]
    same = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{same} {a}")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    five = spark.createDataFrame([(1, f"{a} p q r s"), (2, f"{b} p q r s"), (3, f"{a} p q r s")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.link_documents(five).collect()} == {1: 1, 2: 2, 3: 1}
