"""Mixing, pieces, pages and the pipeline."""

import collections
import random

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import html_text, mixing, pieces
from tidemark.llm.common import stage

SF = "/root/testdata/sf0.01"


def water(sizes):
    """Targets by the rule itself: share by weight, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: float(1 + k % 3) for k, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3.0 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 2, "c": 1000, None: 3}, {"z": 0, "y": 10}, {"x": 0}, {"é": 5, "z": 50, "A": 7, "b": 900, "c": 4}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long"))
    want = water(sizes)
    assert {r["source"]: round(r["target"], 6) for r in got.collect()} == {s: round(t, 6) for s, t in want.items()}


def test_mix(spark, docs, corpus):
    got = mixing.mix_sources(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s in corpus:
        sizes[s] += len(words(t))
    want = water(sizes)
    assert len(got) == len(corpus)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs.repartition(3)).collect()))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0


def test_mix_comes_near_its_targets_and_follows_the_ranks(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 37)) AS text", "CASE WHEN id % 10 < 7 THEN 'big' WHEN id % 10 < 9 THEN 'mid' ELSE 'small' END AS source")
    got = mixing.mix_sources(rows).toPandas()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken / by.target - 1) < 0.002).all()
    again = mixing.mix_sources(rows, seed=8).toPandas()
    assert (again.sort_values("doc_id").copies.to_numpy() != got.sort_values("doc_id").copies.to_numpy()).any()
    weighted = mixing.mix_sources(rows.withColumn("w", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)), weight_col="w").toPandas()
    big = weighted[weighted.source == "big"]
    assert big[big.doc_id % 2 == 0].copies.mean() > 1.5 * big[big.doc_id % 2 == 1].copies.mean()


@pytest.fixture(scope="module")
def vocab():
    with open(pieces.MODEL, "rb") as f:
        return pieces.load(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def encode(vocab, texts, **how):
    e = pieces.Encoder(vocab, **how)
    ids, offsets = e.encode_texts(texts, np.arange(len(texts), dtype=np.uint64) * np.uint64(7919))
    body, ends = pieces.decode_ids(vocab, ids, offsets)
    assert [body[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [t or "" for t in texts]
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeth onrs\n\té漢😀.,1x"), max_size=90), max_size=4))
def test_without_dropout_pieces_are_the_standard_ones(texts):
    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    v = test_without_dropout_pieces_are_the_standard_ones.__dict__.setdefault("vocab", None) or pieces.load(model)
    test_without_dropout_pieces_are_the_standard_ones.vocab = v
    sp = test_without_dropout_pieces_are_the_standard_ones.__dict__.setdefault("sp", None) or sentencepiece.SentencePieceProcessor(model_proto=model)
    test_without_dropout_pieces_are_the_standard_ones.sp = sp
    assert encode(v, texts, dropout=0.0) == [sp.encode(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=4), st.floats(0, 1), st.integers(0, 5))
def test_any_text_comes_back(texts, dropout, seed):
    with open(pieces.MODEL, "rb") as f:
        v = test_any_text_comes_back.__dict__.setdefault("vocab", None) or pieces.load(f.read())
    test_any_text_comes_back.vocab = v
    encode(v, [t.encode("utf-8", "replace").decode() for t in texts], dropout=dropout, seed=seed)


def test_long_words_go_the_same_way_as_short_ones(vocab, library, monkeypatch):
    texts = ["the" * 60 + " internationalization of thoroughness " * 5]
    assert encode(vocab, texts, dropout=0.0) == [library.encode(t) for t in texts]
    plain = encode(vocab, texts, dropout=0.3, seed=4)
    monkeypatch.setattr(pieces, "LONG", 3)
    assert encode(vocab, texts, dropout=0.3, seed=4) == plain
    monkeypatch.setattr(pieces, "SEGMENT", 40)
    assert encode(vocab, ["some words to cut " * 20], dropout=0.0) == [library.encode("some words to cut " * 20)]


def test_dropout_varies_by_seed_and_place_only(vocab, library):
    text = ["understanding international communication " * 30]
    a, b = encode(vocab, text, dropout=0.3, seed=1), encode(vocab, text, dropout=0.3, seed=2)
    assert a != b and a == encode(vocab, text, dropout=0.3, seed=1)
    assert len(a[0]) > len(library.encode(text[0]))
    assert len(encode(vocab, text, dropout=1.0)[0]) == len(text[0]) + 1


def test_every_occurrence_of_a_word_draws_for_itself(vocab, monkeypatch):
    n = 400
    text = ["understanding " * n]
    got = encode(vocab, text, dropout=0.1)[0]
    ends = np.cumsum([int(vocab.body_len[i]) for i in got])
    words = collections.defaultdict(list)
    for i, e in zip(got, ends, strict=True):
        words[(e - 1) // len(" understanding")].append(i)
    assert len({tuple(w) for k, w in words.items() if k < n}) > 12
    monkeypatch.setattr(pieces.Encoder, "_skips", lambda self, points, start, size, key, own: own)  # each alone
    assert encode(vocab, text, dropout=0.1)[0] == got


def test_encode_and_decode_tables(spark, docs, corpus):
    rows = pieces.encode(docs, keep=["doc_id", "lang", "ids", "text"])
    assert rows.columns == ["doc_id", "lang", "text", "ids", "n_pieces", "round_trip", "decoded_sha256"]
    got = rows.collect()
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got) and len(got) == len(corpus)
    back = pieces.decode(rows.withColumnRenamed("text", "was"))
    assert all(r["text"] == (r["was"] or "") for r in back.collect())
    assert pieces.encode(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body class="x">
<header>Site</header><nav><ul><li><a href="/a?x=1>2">Menu</a></ul></nav><div class="cookie-notice">We use</div><!-- <p>no</p> -->
%s
<aside>Side</aside><section id="comments"><p>Nice!</p></section><form><button>Go</button></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE % "<article><h1>A &amp; B</h1><p>one<b> tw</b>o<p>three<br>four &lt;x&gt;\n\n five</article>", "A & B one two three four <x> five"),
        (PAGE % '<main><p class="ad">buy</p><p>kept</p></main>', "kept"),
        (PAGE % "<div><p>plain</p></div>", "plain"),
        ("no markup &copy; at all", "no markup © at all"),
        ("<p>open <i>tags", "open tags"),
        ("<", "<"),
        ("", ""),
        ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<script>never closed <p>x", ""),
        ("<p>a<p>b<!-- never closed", "a b"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page, None) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<html><body class="has-sidebar"><article>kept</article></body></html>', "kept"),
        ('<html class="menu"><body class="single-post comments-open comment-form"><p>kept</p></body></html>', "kept"),
        ('<div id="content" class="with-sidebar"><p>kept</p></div>', "kept"),
        ('<article class="post no-comments"><p>kept</p></article>', "kept"),
        ('<div class="sidebar"><div><article>kept</article></div>beside</div>', "kept"),
        ('<article>kept</article><section id="comments"><article class="comment">nice</article><article>nice</article></section>', "kept"),
        ('<div class="site-header">no</div><div class="nav-list">no</div><div class="box ad">no</div><p>kept</p>', "kept"),
    ],
)
def test_names_of_wrappers_lose_no_article(page, text):
    assert html_text.main_text(page, None) == text


def shaped(page):
    nodes, *arrays = html_text.elements(html_text.parse(page))
    return nodes, html_text.Shape(*arrays)


def test_trees_are_matched_in_order_for_the_most_nodes():
    (an, a), (bn, b) = shaped("<div><p>x</p><ul><li>1<li>2</ul><p>y</p></div>"), shaped("<div><ul><li>1<li>3<li>4</ul><p>y</p></div>")
    pairs = [(an[x].tag, an[x].text, bn[y].text) for x, y in html_text.align(a, b).items()]
    assert len(pairs) == 6 and ("p", "y", "y") in pairs and ("li", "1", "1") in pairs


@pytest.mark.parametrize("wide", [4096, 0])
def test_alignment_is_the_best_of_all(monkeypatch, wide):
    monkeypatch.setattr(html_text, "WIDE", wide)
    rng = random.Random(5)

    def tree(depth):
        tag = rng.choice("bi")
        return f"<{tag}>{rng.choice(['', 'x', 'y'])}{''.join(tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0))}</{tag}>"

    def best(xs, ys, weigh):
        """Weight of the best matching of two lists, by trying all."""
        if not xs or not ys:
            return 0
        w = weigh(xs[0], ys[0])
        return max(best(xs[1:], ys, weigh), best(xs, ys[1:], weigh), w + best(xs[1:], ys[1:], weigh) if w else 0)

    for _ in range(80):
        (_, a), (_, b) = shaped(tree(2)), shaped(tree(2))
        form = lambda x, y: (1 + best(a.kids[x], b.kids[y], form)) if a.keys[x] == b.keys[y] else 0  # noqa: B023, E731
        whole = lambda x, y: 2 * a.size[x] if a.whole[x] == b.whole[y] else form(x, y)  # noqa: B023, E731
        pairs = html_text.align(a, b)
        assert pairs[0] == 0 and all(a.keys[x] == b.keys[y] for x, y in pairs.items())
        for x, y in pairs.items():
            kids = [(k, pairs[k]) for k in a.kids[x] if k in pairs]
            assert all(j in b.kids[y] for _, j in kids) and [j for _, j in kids] == sorted(j for _, j in kids)
            assert sum(whole(i, j) for i, j in kids) == best(a.kids[x], b.kids[y], whole)


def test_deep_and_wide_pages():
    deep = "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000
    assert html_text.main_text(deep, None) == "deep" and html_text.main_text("<b>" * 3000 + "x", None) == "x"
    (_, a), (_, b) = shaped(deep), shaped(deep.replace("deep", "other"))
    assert len(html_text.align(a, b)) == 5003 - 1
    wide = lambda n: "<ul>" + "".join(f"<li><a>item {k * n}</a><b>x</b></li>" for k in range(2000)) + "</ul>"
    assert len(html_text.align(shaped(wide(3))[1], shaped(wide(7))[1])) == 2 + 3 * 2000


def test_wrappers_take_constants_out(spark):
    page = lambda k: f"<html><body><div>Our shop sells shoes</div><div><p>story {k} about {k * k}</p></div><div>Call us</div></body></html>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(8)] + [(50, None, None), (51, "nonsense", ""), (52, "https://lone.example", "<p>alone</p>"), (None, "http://h.example/x", page(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("host", F.lit("y"))
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert all(got[k] == f"story {k} about {k * k}" for k in range(8)) and got[50] == got[51] == "" and got[52] == "alone"
    joined = {r["page_id"]: r["text"] for r in html_text.extract_text(df, broadcast_bytes=0).collect()}
    assert joined == got
    assert html_text.extract_text(df.limit(0)).count() == 0


def extracted(spark, pages, **how):
    rows = [(k, f"http://{host}/{k}", html) for k, (host, html) in enumerate(pages)]
    return [r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **how).orderBy("page_id").collect()]


def test_each_layout_of_a_host_has_its_template(spark):
    one = lambda k: f"<body><div>Our shop sells shoes</div><div><p>story {k}</p></div></body>"
    two = lambda k: f"<body><table><tr><td>Price list of shoes<td>item {k}</table></body>"
    pages = [(f"h{h}.example", one(k)) for h in range(24) for k in range(2)] + [("mixed.example", (one if k % 4 else two)(k)) for k in range(40)]
    want = [f"story {k}" for h in range(24) for k in range(2)] + [f"story {k}" if k % 4 else f"item {k}" for k in range(40)]
    assert extracted(spark, pages) == want == extracted(spark, pages, broadcast_bytes=0)


def test_constants_of_marked_articles_go_and_repeated_articles_stay(spark):
    page = lambda k, text: f"<body><p>top {k}</p><article><h1>title {text}</h1><p>Write to <b>our</b> desk</p><p>a <b>long</b> story about {text} and the rest</p></article></body>"
    pages = [("h.example", page(k, k)) for k in range(10)] + [("few.example", page(k, k)) for k in range(3)] + [("copies.example", page(k, "one")) for k in range(10)]
    full = lambda t: f"title {t} Write to our desk a long story about {t} and the rest"
    want = [full(k).replace("Write to our desk ", "") for k in range(10)] + [full(k) for k in range(3)] + [full("one")] * 10
    assert extracted(spark, pages) == want == extracted(spark, pages, broadcast_bytes=0)


def test_a_constant_is_found_in_its_slot_wherever_it_stands(spark):
    """Of a layout that is rare on its host, a notice behind a varying number of paragraphs is template; the same words elsewhere are not."""
    rare = lambda k: "<body><section>" + "".join(f"<p>part {j} of {k}</p>" for j in range(1 + k % 3)) + "<p>Call us</p></section></body>"
    usual = lambda k: f"<body><div><p>news {k}</p></div><section><p>Call me {k}</p></section></body>"
    pages = [("h.example", rare(k)) for k in range(9)] + [("h.example", usual(k)) for k in range(30)]
    want = [" ".join(f"part {j} of {k}" for j in range(1 + k % 3)) for k in range(9)] + [f"news {k} Call me {k}" for k in range(30)]
    assert extracted(spark, pages) == want == extracted(spark, pages, broadcast_bytes=0)


def test_pipeline_keeps_one_of_each_and_loses_no_clean_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, work in corpus_pipeline.STAGES:
        kept.append(stage(work(spark, kept[-1], SF), name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept[-1].columns == docs.columns
    start, told, exact, near, mixed, done = ([r.asDict() for r in k.select(*(c for c in k.columns if c != "ids")).collect()] for k in kept)
    assert len(told) == sum(any(ch.isalpha() for ch in r["text"]) for r in start)
    best = {}
    for r in told:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(best.values())
    assert {r["doc_id"] for r in near} <= {r["doc_id"] for r in exact} and len(near) > 0.95 * len(exact)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    total = lambda rows: sum(len(words(r["text"])) for r in rows)
    assert abs(total(mixed) / total(near) - 1) < 0.01
    assert len(done) == len(mixed) and all(r["round_trip"] for r in done)
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_on_odd_rows(spark, corpus):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        out = rows
        for name, work in corpus_pipeline.STAGES:
            out = stage(work(spark, out, SF), name)
        assert out.where("not round_trip").count() == 0
