"""Main text of web pages by wrapper induction.

A page's nodes have places: the path of labels from the root (numbers in class
and id names do not count). Its layout is the set of places of its block
elements. Of each host and layout with two or more distinct pages, one page is
the reference; every other is aligned with it by simple tree matching, the
largest ordered matching of nodes with equal labels, in which subtrees that are
equal with their texts count double. So a node has a slot: the node of the
reference that it is matched with.

All distinct pages of a host are counted, in partial aggregations; nothing is
sampled, and the reference only names the slots. A text in a slot is constant,
and belongs to the template of its layout, if it stands on at least two distinct
pages and on more than half of the layout's. For layouts that occur once a text
is constant at its place if it stands on more than half of the host's pages that
have text at the place.

Text that is constant is template; the rest is content, unless its element says
what it is: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are left out by tag, role and class names. Of a page
that marks its article (article, main, role=main) that region alone is content.
In there whole blocks count (a block's text with its inline elements), they must
stand on INSIDE distinct pages at least, and if over half of the marked text
were to go the host repeats the article itself, and all of it stays.

Hosts may be hot: pages meet their template without being grouped by host.
Templates are broadcast while they are at most `broadcast_bytes` together
(measured); beyond that they are joined by host and layout, in joins that
adaptive execution can split.
"""

from __future__ import annotations

import html as html_lib
import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Container, Iterator
from hashlib import blake2b
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import sized, stage, table

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<[/!?a-zA-Z][^>]*>?|(?P<text>[^<]+|<)""",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("head nav header footer aside form button select script style noscript template textarea title iframe svg menu dialog".split())
_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent notice banner ad ads advert advertisement sponsor sponsored promo popup modal newsletter subscribe share social related comment comments disqus replies respond search login".split())
#: Words of reader comments, and what may stand before a word in the name of a page-wide part.
_COMMENTS = frozenset("comment comments disqus replies respond".split())
_WIDE = frozenset("site global main top bottom".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: A start tag that ends open elements of these tags, up to the nearest of the limits.
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {b: ("p",) for b in _BLOCKS}
_LIMITS = frozenset("ul ol dl table article section div body main blockquote td th".split())
#: Cells of an alignment's table above which it is filled by rows, and above which halves are aligned instead.
WIDE, CELLS = 1 << 12, 1 << 22
#: Pairs of forms whose weights are remembered at most.
REMEMBERED = 1 << 20
#: Distinct pages that a constant block of marked articles stands on at least.
INSIDE = 8


def _named(tag: str, names: list[tuple[str, ...]]) -> str:
    """What the class and id names say that an element is: "" (content), "part", or "comments".

    A name counts as a whole or by its first part (nav-list, site-header), not by
    any part: has-sidebar and no-comments say what stands beside the element. An
    article is judged by whole names only; html, body and main are not judged.
    """
    if not names or tag in ("html", "body", "main"):
        return ""
    if any(len(x) == 1 and x[0] in _COMMENTS for x in names):
        return "comments"
    if tag == "article":
        return "part" if any(len(x) == 1 and x[0] in _WORDS for x in names) else ""
    return "part" if any(x[0] in _WORDS or (len(x) == 2 and x[0] in _WIDE and x[1] in _WORDS) for x in names) else ""


class Node:
    __slots__ = ("tag", "key", "drop", "named", "main", "kids", "text")

    def __init__(self, tag: str, names: tuple[str, ...] = (), role: str = ""):
        self.tag = tag
        parts = [tuple(w for w in re.split(r"[^a-z0-9]+", name) if w) for name in names]
        self.key = " ".join((tag, *(w for x in parts for w in x)))
        self.drop = tag in _DROPPED or role in _ROLES
        self.named = _named(tag, [x for x in parts if x])
        self.main = tag in ("article", "main") or role == "main"
        self.kids: list[Node | str] = []
        self.text = ""


def parse(page: str) -> Node:
    """DOM tree of a page as written, however deep."""
    root = Node("#root")
    stack = [root]
    open_tags: Counter[str] = Counter()

    def close_from(i: int) -> None:
        open_tags.subtract(n.tag for n in stack[i:])
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            stack[-1].kids.append(text)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if open_tags[tag] > 0:
                close_from(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag == "p":
                stack[-1].kids.append(Node("br"))
            continue
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in _ENDS.get(tag, ()):
                close_from(i)
                break
            if stack[i].tag in _LIMITS:
                break
        names: tuple[str, ...] = ()
        role = ""
        attrs = m["attrs"]
        if attrs and "=" in attrs:
            for name, *values in _ATTR.findall(attrs):
                value = (values[0] or values[1] or values[2]).lower()
                if name.lower() == "role":
                    role = value.strip()
                else:
                    names += tuple(value.split())
        node = Node(tag, names, role)
        stack[-1].kids.append(node)
        if tag in _RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in _VOID:
            stack.append(node)
            open_tags[tag] += 1
    _measure(root)
    return root


def _measure(root: Node) -> None:
    order = [root]
    for n in order:
        order += [k for k in n.kids if isinstance(k, Node)]
    around = set()  # elements with an article or main inside are not dropped for a name, but for one of reader comments
    for n in reversed(order):
        if any(isinstance(k, Node) and (k.main or id(k) in around) for k in n.kids):
            around.add(id(n))
        n.drop = n.drop or n.named == "comments" or (n.named == "part" and id(n) not in around)
        n.text = " ".join(html_lib.unescape("".join(k for k in n.kids if isinstance(k, str))).split())


def _label(n: Node) -> str:
    return " ".join(w for w in n.key.split(" ") if not w.isdigit())


def elements(tree: Node) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray]:
    """A page's elements in document order, and by element: its label's number, its parent's place, its text's number (0: none)."""
    nodes, parents = [], []
    waiting = [(tree, 0)]
    while waiting:
        n, parent = waiting.pop()
        waiting += [(k, len(nodes)) for k in reversed(n.kids) if isinstance(k, Node)]
        nodes.append(n)
        parents.append(parent)
    number = lambda x: zlib.crc32(x.encode(errors="replace")) + 1
    return nodes, np.array([number(_label(n)) for n in nodes], np.int64), np.array(parents, np.int32), np.array([number(n.text) if n.text else 0 for n in nodes], np.int64)


class Shape:
    """What alignment needs of a page: kids, sizes, and signatures of every subtree without (form) and with its texts (whole)."""

    def __init__(self, keys: np.ndarray, parents: np.ndarray, texts: np.ndarray):
        self.keys = keys.tolist()
        n = len(self.keys)
        self.kids: list[list[int]] = [[] for _ in range(n)]
        for i, p in enumerate(parents.tolist()[1:], 1):
            self.kids[p].append(i)
        self.size, self.form, self.whole = [1] * n, [0] * n, [0] * n
        for i, text in reversed(list(enumerate(texts.tolist()))):
            kids = self.kids[i]
            self.size[i] += sum(self.size[k] for k in kids)
            self.form[i] = hash((self.keys[i], *(self.form[k] for k in kids)))
            self.whole[i] = hash((self.form[i], text, *(self.whole[k] for k in kids)))


def align(a: Shape, b: Shape) -> dict[int, int]:
    """Places of a's elements with those of b that simple tree matching pairs them with.

    Two nodes with equal labels weigh one and what their kids weigh in the best
    ordered matching; subtrees that are equal with their texts weigh double.
    Equal subtrees at either end of two lists of kids are paired at once, which
    no other matching can better. Two lists that would need a table of over CELLS
    cells (thousands of elements side by side) are cut where a best matching of
    both halves of the first meets, until tables are small: the result is a best
    matching too, in memory that grows with the lists and not with their product.
    """
    memo: dict[tuple[int, int], int] = {}

    def weight(x: int, y: int) -> int:
        if a.form[x] == b.form[y]:
            return a.size[x]
        if a.keys[x] != b.keys[y]:
            return 0
        key = (a.form[x], b.form[y])
        if (found := memo.get(key)) is None:
            found = 1 + (best(a.kids[x], b.kids[y]) if a.kids[x] and b.kids[y] else 0)
            if len(memo) >= REMEMBERED:
                memo.clear()
            memo[key] = found
        return found

    def best(xs: list[int], ys: list[int]) -> int:
        if len(xs) * len(ys) <= WIDE:
            return table(xs, ys, weight)[-1][-1]
        last = None
        for last in rows_of(xs, ys, weight):
            pass
        return int(last[-1])

    def with_texts(x: int, y: int) -> int:
        return 2 * a.size[x] if a.whole[x] == b.whole[y] else weight(x, y)

    def table(xs: list[int], ys: list[int], weigh: Callable[[int, int], int]) -> list[list[int]]:
        """Best weights of matchings of leading parts of both lists."""
        if len(xs) * len(ys) > WIDE:
            return wide_table(xs, ys, weigh)
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            last, row = rows[-1], [0]
            for j, y in enumerate(ys):
                best = last[j + 1] if last[j + 1] > row[j] else row[j]
                if (w := weigh(x, y)) and last[j] + w > best:
                    best = last[j] + w
                row.append(best)
            rows.append(row)
        return rows

    def rows_of(xs: list[int], ys: list[int], weigh: Callable[[int, int], int]):
        """The table's rows one after another; equal forms are weighed once for a row."""
        forms, cy = np.unique([b.form[y] for y in ys], return_inverse=True)
        some = [ys[i] for i in np.unique(cy, return_index=True)[1]]
        wy = np.array([b.whole[y] for y in ys])
        held: dict[int, np.ndarray] = {}
        row = np.zeros(len(ys) + 1, np.int32)
        yield row
        for x in xs:
            by_form = held.get(a.form[x])
            if by_form is None:
                if len(held) * len(forms) >= REMEMBERED:
                    held.clear()
                by_form = held[a.form[x]] = np.array([weight(x, y) for y in some], np.int32)
            w = by_form[cy]
            if weigh is with_texts:
                w = np.where(wy == a.whole[x], 2 * a.size[x], w)
            out = np.zeros_like(row)
            out[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(w > 0, row[:-1] + w, 0)))
            row = out
            yield row

    def wide_table(xs: list[int], ys: list[int], weigh: Callable[[int, int], int]) -> np.ndarray:
        return np.stack(list(rows_of(xs, ys, weigh)))

    def cut(xs: list[int], ys: list[int]) -> tuple[int, int]:
        """Where a best matching of both lists can be cut in two: half of the first, and a place in the second."""
        half = len(xs) // 2
        front = back = None
        for front in rows_of(xs[:half], ys, with_texts):
            pass
        for back in rows_of(xs[half:][::-1], ys[::-1], with_texts):
            pass
        return half, int(np.argmax(front.astype(np.int64) + back[::-1]))

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(a.keys) + 1000))
    pairs: dict[int, int] = {}
    waiting = [(0, 0)] if a.keys and b.keys and a.keys[0] == b.keys[0] else []
    while waiting:
        x, y = waiting.pop()
        if a.form[x] == b.form[y] and a.whole[x] == b.whole[y]:  # document order runs through a subtree without gaps
            pairs.update(zip(range(x, x + a.size[x]), range(y, y + b.size[y]), strict=True))
            continue
        pairs[x] = y
        xs, ys = a.kids[x], b.kids[y]
        lo, most = 0, min(len(xs), len(ys))
        while lo < most and a.whole[xs[lo]] == b.whole[ys[lo]]:
            waiting.append((xs[lo], ys[lo]))
            lo += 1
        hi = 0
        while hi < most - lo and a.whole[xs[-1 - hi]] == b.whole[ys[-1 - hi]]:
            waiting.append((xs[-1 - hi], ys[-1 - hi]))
            hi += 1
        xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
        if not xs or not ys:
            continue
        parts = [(xs, ys)]
        while parts:
            xs, ys = parts.pop()
            if not xs or not ys:
                continue
            if len(xs) * len(ys) > CELLS and len(xs) > 1:
                half, place = cut(xs, ys)
                parts += [(xs[:half], ys[:place]), (xs[half:], ys[place:])]
                continue
            rows = table(xs, ys, with_texts)
            i, j = len(xs), len(ys)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    waiting.append((xs[i], ys[j]))
    return pairs


def _flow(n: Node) -> str:
    """Text of a block with its inline elements; what else stands in it is white space."""
    out, waiting = [], [*reversed(n.kids)]
    while waiting:
        k = waiting.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag in _INLINE and not k.drop:
            waiting += reversed(k.kids)
        else:
            out.append(" ")
    return "".join(out)


def _marked(tree: Node) -> list[Node]:
    found: list[Node] = []
    order = [tree]
    for n in order:
        if n.main and not n.drop:
            found.append(n)
        elif not n.drop:
            order += [k for k in n.kids if isinstance(k, Node)]
    return found


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def placed(tree: Node) -> tuple[int, dict[int, tuple[int, int]]]:
    """A page's layout; by node, its place (odd inside a marked article) and its place with its text."""
    found: dict[int, tuple[int, int]] = {}
    blocks: set[bytes] = set()
    tops = _marked(tree)
    waiting = [(n, b"in", 1) for n in tops] or [(tree, b"", 0)]
    while waiting:
        n, above, inside = waiting.pop()
        at = blake2b(above + _label(n).encode(errors="replace"), digest_size=8).digest()
        block = n.tag not in _INLINE
        if block:
            blocks.add(at)
        text = n.text if not inside else " ".join(html_lib.unescape(_flow(n)).split()) if block else ""
        if text:
            found[id(n)] = (_number(at) & ~1 | inside, _number(blake2b(at + text.encode(errors="replace"), digest_size=8).digest()))
        waiting += [(k, at, inside) for k in n.kids if isinstance(k, Node) and (not k.drop or (inside and k.tag == "header"))]
    return _number(blake2b(b"".join(sorted(blocks)), digest_size=8).digest()), found


def _content(tree: Node, marked: list[Node], constant: Container[int]) -> str:
    """Text outside the constant nodes; constant has ids of nodes."""
    out: list[str] = []
    # a header inside a marked article holds its headline
    waiting: list[tuple[Node | str | None, bool]] = [(n, False) for n in reversed(marked or [tree])]
    while waiting:
        n, mute = waiting.pop()
        if n is None:
            out.append(" ")
        elif isinstance(n, str):
            if not mute:
                out.append(html_lib.unescape(n))
        elif not n.drop or (marked and n.tag == "header"):
            if n.tag not in _INLINE:
                out.append(" ")
                waiting.append((None, False))
                mute = False
            gone = id(n) in constant
            # a constant block of an article goes with its inline elements; elsewhere each node is judged by its own text
            waiting += [(k, gone or mute) if isinstance(k, str) or (marked and k.tag in _INLINE) else (k, False) for k in reversed(n.kids)]
    return " ".join("".join(out).split())


def slot_number(slot: int, text: int) -> int:
    """Number of a text (by its number, odd inside a marked article) in a slot."""
    return _number(blake2b(b"%d %d" % (slot, text), digest_size=8).digest()) & ~1 | (text & 1)


def _inside(place: int, text: int) -> int:
    return text & ~1 | (place & 1)


def main_text(page: str, template: Callable[[int], tuple[Container[int], Shape | None]] | None) -> str:
    """Content of a page, given its host's constants for a layout: numbers of texts at places and in slots, and the slots' reference."""
    tree = parse(page)
    marked = _marked(tree)
    constant: set[int] = set()
    if template:
        layout, found = placed(tree)
        known, reference = template(layout)
        if known:
            constant = {n for n, (_, text) in found.items() if text in known}
            if reference:
                nodes, *arrays = elements(tree)
                own = Shape(*arrays)
                for i, slot in align(own, reference).items():
                    if (at := found.get(id(nodes[i]))) and slot_number(slot, _inside(*at)) in known:
                        constant.add(id(nodes[i]))
    text = _content(tree, marked, constant)
    if marked and constant and 2 * len(text) < len(whole := _content(tree, marked, ())):
        return whole
    return text


ELEMENTS = "keys array<long>, parents array<int>, labels array<long>"
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def _shape(row: dict) -> Shape:
    return Shape(*(np.array(row[c], np.int64) for c in ("keys", "parents", "labels")))


def constants(rows: DataFrame) -> DataFrame:
    """host, layout (null: all layouts), texts and reference (null without a layout): what is constant, from all of rows (host, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("layout", "places", "texts", "nodes", "keys", "parents", "labels")}
            for page in batch.column("html").to_pylist():
                tree = parse(page)
                layout, found = placed(tree)
                nodes, keys, parents, labels = elements(tree)
                at = [(i, *found[id(n)]) for i, n in enumerate(nodes) if id(n) in found]
                for c, v in zip(out, (layout, [p for _, p, _ in at], [t for *_, t in at], [i for i, *_ in at], keys, parents, labels), strict=True):
                    out[c].append(v)
            kinds = [pa.int64(), _LONGS, _LONGS, _INTS, _LONGS, _INTS, _LONGS]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["host", "page", *out])

    kind = f"host string, page long, layout long, places array<long>, texts array<long>, nodes array<int>, {ELEMENTS}"
    read_ = rows.where("html <> ''").select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(read, kind)
    pages = stage(read_.groupBy("host", "page").agg(*(F.first(c).alias(c) for c in ("layout", "places", "texts", "nodes", "keys", "parents", "labels"))), "page-places")
    layouts = pages.groupBy("host", "layout").agg(F.count("*").alias("of"), F.min_by(F.struct("keys", "parents", "labels"), "page").alias("reference")).where("of > 1")
    layouts = stage(layouts, "layouts")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, Shape] = {}
            out = []
            for r in batch.to_pylist():
                key = (r["host"], r["layout"])
                if key not in held:
                    held[key] = _shape(r["reference"])
                to = align(_shape(r), held[key])
                out.append(sorted({slot_number(to[i], _inside(p, t)) for i, p, t in zip(r["nodes"], r["places"], r["texts"], strict=True) if i in to}))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(out, _LONGS)], names=["host", "layout", "slots"])

    aligned = pages.join(sized(layouts.select("host", "layout", "reference"), 1 << 13), ["host", "layout"]).select("host", "layout", "places", "texts", "nodes", "keys", "parents", "labels", "reference")
    in_slots = aligned.mapInArrow(slots, "host string, layout long, slots array<long>").select("host", "layout", F.explode("slots").alias("text")).groupBy("host", "layout", "text").agg(F.count("*").alias("n"))
    pairs = F.array_distinct(F.arrays_zip("places", "texts"))
    in_host = pages.select("host", F.explode(pairs).alias("x")).select("host", F.col("x.places").alias("place"), F.col("x.texts").alias("text")).groupBy("host", "place", "text").agg(F.count("*").alias("n"))
    of_place = pages.select("host", F.explode(F.array_distinct("places")).alias("place")).groupBy("host", "place").agg(F.count("*").alias("of")).where("of > 1")
    least = lambda number: F.when(F.col(number).bitwiseAND(1) == 1, INSIDE).otherwise(2)
    most = lambda counted, pages, on, number: counted.where(F.col("n") >= least(number)).join(sized(stage(pages, "page-counts")), on).where("2 * n > of")
    by_slot = most(in_slots, layouts.select("host", "layout", "of"), ["host", "layout"], "text").groupBy("host", "layout").agg(F.collect_set("text").alias("texts"))
    by_place = most(in_host, of_place, ["host", "place"], "place").groupBy("host").agg(F.collect_set("text").alias("texts"))
    with_reference = by_slot.join(layouts.select("host", "layout", "reference"), ["host", "layout"])
    nothing = F.lit(None).cast(layouts.schema["reference"].dataType)
    return stage(with_reference.unionByName(by_place.select("host", F.lit(None).cast("long").alias("layout"), "texts", nothing.alias("reference"))), "templates")


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of pages: id_col, url_col, text, n_chars.

    A null or empty page gives an empty text; a null or hostless address shares
    one template with others like it. A host with one distinct page has no
    constants. Repeated rows give equal results; other columns are ignored, and
    an empty table gives an empty result. Elements may be nested as deep as they
    like.
    """
    ship(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    templates = constants(rows)
    total = templates.agg(F.sum(F.octet_length("host") + 8 * F.size("texts") + 20 * F.coalesce(F.size("reference.keys"), F.lit(0)) + 8)).first()[0] or 0
    small = None
    if total <= broadcast_bytes:
        packed = lambda r: r and tuple(np.array(r[c], np.int64).tobytes() for c in ("keys", "parents", "labels"))
        small = pages.sparkSession.sparkContext.broadcast({(r["host"], r["layout"]): (np.array(r["texts"], np.int64).tobytes(), packed(r["reference"])) for r in templates.collect()})
    else:

        def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("layout", pa.array([placed(parse(p))[0] for p in batch.column("html").to_pylist()], pa.int64()))

        rows = rows.mapInArrow(lay, T.StructType([*rows.schema.fields, T.StructField("layout", T.LongType())]))
        rows = rows.join(templates.where("layout is null").select("host", F.col("texts").alias("of_host")), "host", "left")
        rows = rows.join(templates.where("layout is not null").select("host", "layout", F.col("texts").alias("of_layout"), "reference"), ["host", "layout"], "left")
        none = F.array().cast("array<long>")
        rows = rows.select("id", "url", "html", "host", F.concat(F.coalesce("of_host", none), F.coalesce("of_layout", none)).alias("texts"), "reference")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(512)
        def known(host: str, layout: int | None) -> tuple[frozenset[int], Shape | None]:
            texts, reference = small.value.get((host, layout), (b"", None))
            own = frozenset(np.frombuffer(texts, np.int64).tolist())
            if layout is None:
                return own, None
            return own | known(host, None)[0], Shape(*(np.frombuffer(x, np.int64) for x in reference)) if reference else None

        def joined(texts: list[int], reference: dict | None) -> Callable[[int], tuple[frozenset[int], Shape | None]]:
            return lambda _: (frozenset(texts), _shape(reference) if reference else None)

        for batch in batches:
            given = [partial(known, h) for h in batch.column("host").to_pylist()] if small else map(joined, batch.column("texts").to_pylist(), batch.column("reference").to_pylist())
            texts = [main_text(p, t) for p, t in zip(batch.column("html").to_pylist(), given, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, kind)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_text of all pages with production parameters."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
