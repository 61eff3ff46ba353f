"""Alignment of pages with thousands of elements side by side: the same weight as with a whole table, in little memory."""

import random
import tracemalloc

import pytest

from tidemark.llm import html_text as H


def shape(items):
    _, keys, parents, texts = H.elements(H.parse("<html><body><main><ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul></main></body></html>"))
    return H.Shape(keys, parents, texts)


def total(a, b, pairs):
    """What the matching weighs: paired elements, and once more those of subtrees that are equal with their texts."""
    assert all(a.keys[x] == b.keys[y] for x, y in pairs.items()) and len(set(pairs.values())) == len(pairs)
    return len(pairs) + sum(a.whole[x] == b.whole[y] for x, y in pairs.items())


@pytest.mark.parametrize("cells, wide", [(16, 1 << 12), (16, 4), (1, 1)])
def test_halves_weigh_what_a_table_does(monkeypatch, cells, wide):
    rng = random.Random(cells + wide)
    parts = ["a", "b", "<b>c</b>", "<p>d<i>e</i></p>", "<p>f</p>", "<table><tr><td>x</table>"]
    for _ in range(40):
        a, b = (shape([rng.choice([*parts, f"g{rng.randrange(30)}"]) for _ in range(rng.randrange(2, 80))]) for _ in range(2))
        whole = total(a, b, H.align(a, b))
        monkeypatch.setattr(H, "CELLS", cells)
        monkeypatch.setattr(H, "WIDE", wide)
        assert total(a, b, H.align(a, b)) == whole
        monkeypatch.undo()


def test_long_lists_fit_in_memory():
    rng = random.Random(2)
    a, b = (shape([f"item {rng.randrange(10**6)}" for _ in range(12_000 + k)]) for k in range(2))
    tracemalloc.start()
    pairs = H.align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == 12_000 + 5 and peak < 200 << 20


def test_a_long_list_on_pages(spark):
    rng = random.Random(3)
    page = lambda k: "<html><body><nav>Menu</nav><ul>" + "".join(f"<li>entry {k} {rng.randrange(10**6)}</li>" for _ in range(3000)) + "</ul></body></html>"
    long = "<html><body><nav>Menu</nav><main>" + "<p>words of a very long page </p>" * 300_000 + "</main></body></html>"  # about 10 MB
    rows = [(k, f"http://h.example/list/{k}", page(k)) for k in range(4)] + [(9, "http://other.example/long", long)]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == " ".join(["words of a very long page"] * 300_000)
    assert all(got[k].count(f"entry {k} ") == 3000 and "Menu" not in got[k] for k in range(4))
