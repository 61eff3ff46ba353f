"""Cross-tokenizer alignment against the libraries' own tokens of whole texts, aligned byte by byte."""

import hashlib
import json
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment as A
from tidemark.llm.queries import QUERIES

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(libraries, text):
    """Ids and end bytes of both sides, or nothing."""
    a, b = libraries
    if not text:
        return None
    letters = A._byte_letters()
    sides = []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    sides.append((ids, [bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"?" for i in ids]))
    ids = b.encode(text)
    sides.append((ids, [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]))
    if any(b"".join(spelt) != (" " + text).encode() for _, spelt in sides):
        return None
    return [(ids, list(accumulate(map(len, spelt)))) for ids, spelt in sides]


def aligned(sides):
    """Group text and links of two sides."""
    (a, a_ends), (b, b_ends) = sides
    groups, i, j = [], 0, 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        x, y = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    links, i, j = [], 0, 0
    while i < len(a):
        links.append((a[i], b[j]))
        step = a_ends[i] <= b_ends[j], b_ends[j] <= a_ends[i]
        i, j = i + step[0], j + step[1]
    return groups, links


def expected(libraries, rows):
    found = [aligned(s) if (s := tokens(libraries, t)) else ([], []) for _, t in rows]
    counts = Counter(p for _, links in found for p in set(links))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (i, t), (groups, links) in zip(rows, found, strict=True):
        s = tokens(libraries, t)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if s else ""
        out.append((i, *((len(s[0][0]), len(s[1][0])) if s else (0, 0)), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), sha))
    return out, counts, top


def texts():
    rng = random.Random(6)
    letters = "aaaeethsnldrz   '\n\t.,1239éü漢字😀-—\x00  "
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(250)]
    out += ["the quick brown fox " * 40, "unbelievably misaligned internationalisation", "w" * 3000, " " * 700 + "x" + " " * 90, "漢" * 500, "xyzzy" * 300, "a▁b", "▁", "<s> </s> <|endoftext|> <0x41>", " lead", "trail ", "trail\n\n", "\n  two", "a \n b", "\x1c x", " ", "\n", "é", "ﬁ ﬀ ½ Å", "ＡＢ"]
    return out


def test_equals_whole_texts(spark, libraries):
    rows = list(enumerate(texts())) + [(None, None), (5, ""), (7, "the same row"), (7, "the same row")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("n_a", F.lit("clash")).withColumn("links", F.lit(2))
    got, pairs = A.align_documents(df, keep=["doc_id", "words", "n_a", "links"])
    assert got.columns == ["doc_id", "words", "links", *NAMES]
    want, counts, top = expected(libraries, rows)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, *(r[n] for n in NAMES)) for r in got.collect()), key=key) == sorted(want, key=key)
    assert {(r.a, r.b): (r.n_docs, r.is_best) for r in pairs.collect()} == {p: (n, n == top[p[0]]) for p, n in counts.items()}


@pytest.mark.parametrize("page, words, broadcast", [(200, 50, 0), (1 << 20, 1 << 19, 1 << 20)])
def test_pages_and_memory_change_nothing(spark, libraries, monkeypatch, page, words, broadcast):
    monkeypatch.setattr(A, "PAGE", page)
    monkeypatch.setattr(A, "WORDS", words)
    monkeypatch.setattr(A, "PAIRS", broadcast)
    rows = list(enumerate(texts()[100:]))
    got, _ = A.align_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, *(r[n] for n in NAMES)) for r in got.collect()) == sorted(expected(libraries, rows)[0])


def test_words_encoded_together_or_alone(libraries):
    tools = A._tools(A._read(None, A.A_FILE), A._read(None, A.B_FILE))
    for words in (["plain", "words", "x" * 500, "é漢", "it's"], ["plain", "words", "", "ends ", "\n", "a▁b", "\x1c", "é"], ["one"], ["ends\n"], [" two", "x"], ["a", "\n b", "c"]):
        tools.index.clear()
        tools.whole = []
        tools.a.clear()
        tools.b.clear()
        list(map(tools.index.__getitem__, words))
        tools._add(tools.index.new)
        tools.index.new = []
        for side, whole in ((tools.a, lambda w: libraries[0].encode(" " + w, add_special_tokens=False).ids), (tools.b, lambda w: libraries[1].encode(w) if w else libraries[1].encode("x ")[-1:])):
            assert len(side.lens) == len(words)
            for s, n, w in zip(side.starts, side.lens, words, strict=True):
                assert side.flat[s : s + n].tolist() == whole(w)
        assert np.concatenate(tools.whole).tolist() == ["▁" not in w for w in words]


def test_ranks_encode_as_the_file_says(libraries, spark):
    file = A._read(None, A.A_FILE)
    tools = A._tools(file, A._read(None, A.B_FILE))
    every = "".join(chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)])
    own = texts() + [every[i : i + 5000] for i in range(0, len(every), 5000)] + [f"a{c}1{c}! {c}" for c in "՘֋꟎\U00011de1½²ⅷ\u0085\u2028\u200b"]
    own += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    got = A._by_ranks(file, [tools.a.bytes.body[s : s + n].tobytes() for s, n in zip(tools.a.bytes.start, tools.a.bytes.size, strict=True)])
    assert got(own) == [e.ids for e in libraries[0].encode_batch(own, add_special_tokens=False)]
    changed = json.loads(file)
    changed["model"]["merges"][:2] = changed["model"]["merges"][1::-1]
    assert A._by_ranks(json.dumps(changed).encode(), [b"x"] * 256) is None


def test_layouts_that_share_a_fingerprint(monkeypatch):
    ends = np.array([1, 2, 1, 3, 1, 2], np.int32)
    sides = [(ends, np.array([0, 2, 4, 6]))] * 2
    first, which = A._layouts(sides)
    assert which[0] == which[2] != which[1] and len(first) == 2
    monkeypatch.setattr(A, "mix", lambda x: x * np.uint64(0))
    first, which = A._layouts(sides)
    assert which.tolist() == [0, 1, 2]


def test_words_share_groups(spark, libraries):
    parts = ["alpha", "misaligned", "x9", "漢", "unbelievably", "é!", "tion", "42"]
    rows = [(k, " ".join("-".join((x, y, z)) for y in parts for z in parts)) for k, x in enumerate(parts)]
    (page,) = A.tokenise(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), keep=["doc_id"]).collect()
    groups = [(tuple(g.a_ids), tuple(g.b_ids)) for g in page.groups]
    assert len(page.words) == len(parts) ** 3 and len(groups) == len(set(groups)) < len(page.words) // 4
    assert len(page.layouts) == len({(tuple(x.a_ends), tuple(x.b_ends)) for x in page.layouts}) < len(groups)
    assert all(set(x.a_ends) & set(x.b_ends) == {x.a_ends[-1]} for x in page.layouts)
    text = lambda g: ",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1]))
    for d in page.docs:
        want, _ = aligned(tokens(libraries, rows[d.doc_id][1]))
        assert d.n_groups == len(want) and [text(groups[g]) for w in d.words for g in page.words[w]] == want


def test_a_long_word_with_large_groups(spark):
    rng = random.Random(1)
    a = sorted(rng.sample(range(1, 4000), 900)) + [4000]
    b = sorted(rng.sample([x for x in range(1, 4000) if x not in set(a)], 700)) + [4000]
    cut = sorted({*a, 1000, 2000})
    rows = [([*range(len(x))], x, [*range(len(y))], y) for x, y in ((a, b), (cut, sorted({*b, 1000, 2000})), (a, a), ([4], [1, 2, 4]), ([1, 4], [4]))]
    df = spark.createDataFrame(rows, "a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>")
    filled = A._let(A._layout(F.struct("a_ends", "b_ends")), lambda x: A._filled(x, F.col("a_ids"), F.col("b_ids"), lambda i, j: i * 10000 + j))
    got = df.select(filled.alias("x")).select("x.*").collect()
    for (ai, ae, bi, be), r in zip(rows, got, strict=True):
        groups, links = aligned(((ai, ae), (bi, be)))
        assert (r.n_groups, r.groups, sorted(r.links)) == (len(groups), ";".join(groups), sorted(x * 10000 + y for x, y in links))


def test_empty_table(spark):
    got, pairs = A.align_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert got.collect() == [] and pairs.collect() == []


def test_query(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op11_cross_tokenizer"](spark, sf).collect()
    assert sorted((r.doc_id, *(r[n] for n in NAMES)) for r in got) == sorted(expected(libraries, rows)[0])
