"""Byte-level BPE against its public library, against merging step by step, and against encoding edited texts anew."""

import base64
import hashlib
import random
import time
from array import array

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe as B
from tidemark.llm.queries import QUERIES

ODD = "՘֋꟎\U00011de1"  # classes differ between Unicode versions


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.tools()[0].rank, special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "aaaeethsnldr  '\n\t.,1239éü漢字😀▁-—\x00" + ODD
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) * rng.choice([1, 1, 1, 7]) for _ in range(n)]


TEXTS = ["", " ", "<|endoftext|> x", "it's we'll we'r", "w" * 5000, " " * 3000 + "x", "ab" * 3000, "漢" * 2000, "-" * 500 + "=" * 500, "a" + ODD + "1" + ODD + "!"]


def by_merging(rank, word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        least, i = min((rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if least == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [rank[p] for p in parts]


def test_words_equal_merging_step_by_step(vocabulary):
    encoder, splitter = vocabulary.tools()
    for text in random_texts(300, 1):
        for word in splitter.split(text):
            assert encoder.encode(word.encode()) == by_merging(encoder.rank, word.encode())


def test_every_prefix_has_its_own_last_token(vocabulary):
    encoder, _ = vocabulary.tools()
    word = "  unbelievablyéness--==".encode()
    last = encoder.extend([], word)
    assert [encoder.read_off(last, 0, n)[-1] for n in range(1, len(word) + 1)] == last
    assert all(by_merging(encoder.rank, word[:n]) == encoder.read_off(last, 0, n) for n in range(1, len(word) + 1))
    assert encoder.extend(encoder.extend([], word[:9]), word) == last


def test_encode_equals_library(spark, vocabulary, library):
    texts = TEXTS + random_texts(400, 2)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (7, None), (3, "a repeated id")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(1))
    got = B.encode(df, keep=["doc_id", "text", "ids"], vocabulary=vocabulary)
    assert got.columns == ["doc_id", "text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = B.decode(got, vocabulary=vocabulary).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert B.encode(df.limit(0), vocabulary=vocabulary).collect() == []


def test_edits_equal_encoding_anew(spark, vocabulary, library):
    rng = random.Random(5)
    rows = []
    for i, t in enumerate(random_texts(300, 3) + ["plain words " * 400]):
        at = rng.choice([len(t), rng.randrange(len(t) + 1), None])
        rows.append((i, t, at, rng.choice([0, 1, 3, 1000, None]), rng.choice(["", "x", "'ll", "  ", "é漢" + ODD, None])))
    rows.append((9999, None, None, None, "from nothing"))
    df = spark.createDataFrame(rows, "doc_id long, text string, at int, gone int, new string")
    after = B.edited(B.prefixes(df, keep=["doc_id", "at", "gone", "new"], vocabulary=vocabulary), at="at", gone="gone", new="new", vocabulary=vocabulary)
    got = {r.doc_id: r for r in B.tokens(after.withColumn("t", F.col("text")), vocabulary=vocabulary).collect()}
    for i, t, at, gone, new in rows:
        t = t or ""
        at = len(t) if at is None else at
        want = t[:at] + (new or "") + t[at + (gone or 0) :]
        assert got[i].t == want and got[i].ids == library.encode_ordinary(want)
    assert got[300].n_worked < 40  # near the edit only


def test_append_works_out_the_new_bytes_only(vocabulary):
    encoder, splitter = vocabulary.tools()
    text, new = "some words and unfinishe", "dness"
    last = array("i")
    for word in splitter.split(text):
        last.extend(encoder.extend([], word.encode()))
    changed, out, worked = B._edit((encoder, splitter), text, last, len(text), 0, new)
    assert worked == len(new) and out[: len(last)] == last


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_columns_are_cut_as_the_pattern_does(vocabulary):
    _, splitter = vocabulary.tools()
    rng = random.Random(11)
    letters = "''''''stmdrevl  \t\n\r\x0b\x1c\x1f\x85\xa0　aZé漢1²९😀!-́\x00" + ODD
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(20_000)]
    texts += ["", None, "'", "'s", "'r", "'re", "x'", "'l", " '", "' s", "'r", "e", "'", "s", "'sss", "''s", "'s's", "a  ", " b", "\n", "c"]
    for column in (pa.array(texts), pa.array(texts).slice(7, 500), pa.array(["plain 'll text\n\n x", None]), pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        words, rows = splitter.column(column)
        found = words.to_pylist()
        assert [found[i:j] for i, j in zip(rows, rows[1:], strict=False)] == [[w.encode() for w in splitter.split(t)] if t else [] for t in column.to_pylist()]


def test_words_of_a_column_equal_the_library(monkeypatch, vocabulary, library):
    encoder, splitter = vocabulary.tools()
    texts = TEXTS + random_texts(500, 12) + ["x" * n for n in range(B.LONGEST - 3, B.LONGEST + 4)] + ["".join(random.Random(n).choices("-=", k=400)) for n in range(60)]
    for block, places in ((B.BLOCK, B.PLACES), (50, 4)):  # blocks of a few words, and pairs that take each other's places
        monkeypatch.setattr(B, "BLOCK", block)
        monkeypatch.setattr(B, "PLACES", places)
        monkeypatch.setattr(encoder, "answers", encoder.answers[: 1 << places])
        encoder.answers[:] = -1
        words, rows = splitter.column(pa.array(texts))
        ids, ends = encoder.encode_column(words)
        bounds = ends[rows]
        for t, i, j in zip(texts, bounds, bounds[1:], strict=False):
            assert ids[i:j].tolist() == library.encode_ordinary(t)


def test_other_patterns_and_vocabularies(spark, tmp_path, vocabulary):
    """A pattern that leaves text out and matches nothing in places; a vocabulary with gaps between its ranks."""
    ranks = {bytes([i]): 2 * i for i in range(256)} | {b"ab": 600, b"abab": 700, b"ba": 800}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own = B.Vocabulary(str(path), r"[ab]*|\d")
    texts = ["ababa xx7 bab", "", "漢", "a" * 700]
    got = B.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary=own).collect()
    for r in got:
        words = [w.encode() for w in regex.findall(own.pattern, texts[r.doc_id])]
        assert r.ids == [i for w in words for i in by_merging(ranks, w)]
        assert r.decoded_sha256 == hashlib.sha256(b"".join(words)).hexdigest()


def test_a_column_takes_less_than_word_by_word(vocabulary):
    """cutting texts and encoding their different words one by one took most of the budget of op13."""
    rng = random.Random(13)
    texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 12))) for _ in range(400)) for _ in range(100)]
    encoder, splitter = vocabulary.tools()
    encoder.encode_column(splitter.column(pa.array(texts))[0])  # both know the pairs
    start = time.process_time()
    for word in {w for t in texts for w in splitter.split(t)}:
        encoder.encode(word.encode())
    middle = time.process_time()
    encoder.encode_column(splitter.column(pa.array(texts))[0])
    assert time.process_time() - middle < 0.6 * (middle - start)
