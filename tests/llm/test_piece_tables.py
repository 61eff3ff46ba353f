"""Short words are merged by a table of their pieces, with the same results as by looking up pairs."""

import random

import numpy as np
import pytest

from tidemark.llm import pieces


@pytest.fixture(scope="module")
def vocab():
    with open(pieces.MODEL, "rb") as f:
        return pieces.load(f.read())


def words(n, longest, seed):
    """Words of all lengths up to the longest, some of parts that recur."""
    rng = random.Random(seed)
    parts = ["the", "ing", "nation", "under", "aaa", "é", "漢", "😀", "▁", "1", "x"]
    made = ["".join(rng.choices("etaoinshrdlu", k=k)) for k in range(1, longest + 1)]
    return made + ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(n)]


def encode(vocab, texts, dropout, **how):
    ids, ends = pieces.Encoder(vocab, dropout, 5, **how).encode_texts(texts, np.arange(len(texts), dtype=np.uint64))
    return ids.tolist(), ends.tolist()


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6, 1.0])
@pytest.mark.parametrize("variants", [0, 3])
@pytest.mark.parametrize("cells", [pieces.SEGMENT, 1])
def test_tables_and_pairs_give_the_same(vocab, monkeypatch, dropout, variants, cells):
    texts = [" ".join(words(60, 70, seed) * 2) for seed in range(2)] + ["", None, " ", "▁", "  a  "]
    monkeypatch.setattr(pieces, "CELLS", cells, raising=False)
    got = encode(vocab, texts, dropout, variants=variants)
    monkeypatch.setattr(pieces, "LONG", 0)  # all words by agenda, each pair looked up
    assert encode(vocab, texts, dropout, variants=variants) == got


def test_short_words_look_up_no_pairs(vocab, monkeypatch):
    """each round looked up all new pairs among the vocabulary's sorted ones, for every word again."""
    texts = [" ".join(words(200, pieces.LONG - 1, 3))]
    want = encode(vocab, texts, 0.1)
    looked = []
    look = pieces.Encoder._look
    monkeypatch.setattr(pieces.Encoder, "_look", lambda self, *x: looked.append(len(x[0])) or look(self, *x))
    assert encode(vocab, texts, 0.1) == want and not looked


def test_any_edge_of_the_trie_is_found(vocab):
    """Also those whose place in the table others hold, and none that is not there."""
    there = np.flatnonzero(vocab.edges >= 0)
    edges = vocab.edges[there]
    e = pieces.Encoder(vocab, 0.1)
    assert (e._step(edges >> 21, edges & ((1 << 21) - 1)) == vocab.below[there]).all()
    other = np.setdiff1d(np.r_[edges + 1, edges + (1 << 21)], edges)
    assert not e._step(other >> 21, other & ((1 << 21) - 1)).any()
