"""Groups and links between two tokenizers' tokens of the same text.

Tokens of both sides cover the same bytes. Where a token of either side ends at
the same byte, the text can be cut; the tokens between two cuts are a group.
Within a group, tokens whose bytes overlap are linked.

Neither side has tokens across a space that follows something else, so a text is
cut into words there, and each is tokenised once for a page of documents. Words
share most of their groups, so these are told apart too. A page is a row with the
distinct pairs of arrays of end bytes (a layout), the layout and ids of its
distinct groups, the numbers of each distinct word's groups and, for each
document, the numbers of its words. All else is higher-order functions of Spark:
a layout's cuts are the intersection of its two arrays of ends; a cut's place
among a side's tokens is its place in the sorted union of both less the cuts
before it; groups are slices between places, links come from the groups. A group
fills its ids into its layout, a word's text and links are those of its groups in
turn, and a document's those of its words. Every step is linear in the tokens or
sorts them, also in a long word without cuts.

A pair of ids counts once for each document that links it. Pairs are counted with
partial sums before the shuffle; the counts meet the documents' links by a
broadcast if they are few enough (counted), else by a shuffled join.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import sized, stage, table
from .words import U64, give_back, mix
from .words import pieces as slices

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Words, and tokens of words, that a worker remembers at most.
WORDS, TOKENS = 1 << 18, 1 << 22
#: Words that are encoded together.
TOGETHER = 1 << 12
#: Bytes of a page's texts, unless one text is longer.
PAGE = 1 << 22
#: Pairs of ids that are broadcast at most.
PAIRS = 1 << 20
_CUT, _BLANK = re.compile(r"(?<=\S)(?= )").split, re.compile(r"\s ").search


# --- tokenising --------------------------------------------------------------------------------------------------------


class _Bytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, of_id: list[bytes]):
        self.size = np.array([len(x) for x in of_id], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)][:-1]
        self.body = np.frombuffer(b"".join(of_id), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lens = self.size[ids]
        total = np.cumsum(lens)
        return self.body[np.repeat(self.start[ids] - total + lens, lens) + np.arange(total[-1] if len(total) else 0)]


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """Ids of remembered words, one after another. Words are encoded with a space in front."""

    def __init__(self, encode, of_id: list[bytes]):
        self.encode = encode  # lists of texts -> lists of ids of a space and each text
        self.bytes = _Bytes(of_id)
        self.clear()

    def clear(self) -> None:
        self.flat, self.used, self.lens, self.starts = np.zeros(1 << 16, np.int32), 0, array("q"), array("q")

    def keep(self, ids: np.ndarray, lens: np.ndarray) -> None:
        """Ids of words, and how many each word has."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts.frombytes((self.used + np.cumsum(lens) - lens).tobytes())
        self.lens.frombytes(lens.tobytes())
        self.used += len(ids)

    def forget(self, held: int, most: int) -> None:
        """Drop what has been kept beyond `held` words."""
        del self.starts[held:], self.lens[held:]
        self.used = self.starts[-1] + self.lens[-1] if held else 0

    def add_together(self, joined: str, text: np.ndarray, stops: np.ndarray) -> bool:
        """Keep the words of a text that end at the bytes `stops`; nothing if tokens reach over them or do not spell the text."""
        ids = np.array(self.encode([joined])[0], np.int32)
        ends = np.cumsum(self.bytes.size[ids])
        if len(ids) == 0 or ends[-1] != len(text):
            return False
        last = np.searchsorted(ends, stops)
        if not np.array_equal(ends[last], stops) or not np.array_equal(self.bytes.joined(ids), text):
            return False
        self.keep(ids, np.diff(np.r_[-1, last]))
        return True

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        """How many tokens each of the words has."""
        return np.array(self.lens)[numbers]

    def flat_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' ids, their end bytes when the words stand one after another, and bounds of each word in both."""
        lens = self.sizes(numbers)
        total = np.cumsum(lens)
        at = np.repeat(np.array(self.starts)[numbers] - total + lens, lens) + np.arange(total[-1] if len(total) else 0)
        ids = self.flat[at]
        return ids, np.cumsum(self.bytes.size[ids]), np.r_[0, total]


def _list(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _taken(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at the places `which`, and their bounds."""
    lens = np.diff(bounds)[which]
    total = np.cumsum(lens)
    at = np.repeat(bounds[which] - total + lens, lens) + np.arange(total[-1] if len(total) else 0)
    return values[at], np.r_[0, total]


def _groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both sides' end bytes counted from the start of their group, and bounds of the groups among them.

    The ends ascend and stop at the same byte; a group ends where both sides have one.
    """
    size = int(a_ends[-1]) + 1 if len(a_ends) else 0
    found, bounds = [], []
    for own, other in ((a_ends, b_ends), (b_ends, a_ends)):
        is_end = np.zeros(size, bool)
        is_end[other] = True
        last = np.flatnonzero(is_end[own])
        bounds.append(np.r_[0, last + 1])
        found.append((own - np.repeat(np.r_[0, own[last]][:-1], np.diff(bounds[-1]))).astype(np.int32))
    return found, bounds


def _layouts(sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Places that have each layout, and every place's layout; sides are (ends, bounds). Groups of ids are told apart likewise.

    Layouts are told by a fingerprint and then compared with the one that stands for them.
    """
    n = len(sides[0][1]) - 1
    told = np.zeros(n, np.uint64)
    for k, (ends, bounds) in enumerate(sides):
        lens = np.diff(bounds)
        step = mix(ends.astype(np.uint64) * U64(2) + U64(k + 1))
        place = np.arange(len(ends)) - np.repeat(bounds[:-1], lens)
        sums = np.r_[U64(0), np.cumsum(mix(step + place.astype(np.uint64)))]
        told = mix(told + sums[bounds[1:]] - sums[bounds[:-1]])
    _, first, which = np.unique(told, return_index=True, return_inverse=True)
    for ends, bounds in sides:
        other, own = _taken(ends, bounds, first[which])
        if not (np.array_equal(own, bounds) and np.array_equal(other, ends)):
            return np.arange(n), np.arange(n)  # two layouts under one fingerprint: each place gets its own
    return first, which


def _by_ranks(a_json: bytes, of_id: list[bytes]):
    """An encoder of A that works by ranks, many times faster on words that are new; none for a file that it would not be the same for.

    A byte-level vocabulary whose merges make the ids in order is one whose ids
    are ranks. Its words are cut by the same pattern, for which both libraries
    follow one version of Unicode.
    """
    import public_tokenizers
    import tiktoken

    told = json.loads(a_json)
    model, cut = told["model"], told["pre_tokenizer"] or {}
    plain = told["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and model["type"] == "BPE"
    if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    first = 256
    if any(model["vocab"].get("".join(m)) != first + k for k, m in enumerate(merges)) or sorted(map(len, of_id[:first])) != [1] * first:
        return None
    ranks = {of_id[i]: i for i in range(first + len(merges))}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [encoding.encode_ordinary(t) for t in texts]


class _Tokenizers:
    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(a_json.decode())
        a.encode_special_tokens = True
        letters = _byte_letters()
        a_bytes = [b""] * a.get_vocab_size()
        for token, i in a.get_vocab(with_added_tokens=False).items():
            a_bytes[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        b_bytes = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
        own = _by_ranks(a_json, a_bytes) or (lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)])
        self.a = _Side(lambda texts: own([" " + t for t in texts]), a_bytes)
        space = [b.piece_to_id("▁")]  # a text's last space; alone, no text, it would get nothing
        self.b = _Side(lambda texts: [ids if t else space for t, ids in zip(texts, b.encode(texts, num_threads=1), strict=True)], b_bytes)
        self.whole: list[np.ndarray] = []
        self.index = _Numbers()

    def number(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, and how many each text has. A word goes without the space that it starts with."""
        if len(self.index) > WORDS or max(self.a.used, self.b.used) > TOKENS:
            self.index.clear()
            self.a.clear()
            self.b.clear()
            self.whole = []
        cut = [_words(t) if t else [] for t in texts]
        counts = np.array([len(x) for x in cut], np.int64)
        numbers = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if self.index.new:
            new, self.index.new = self.index.new, []
            for i in range(0, len(new), TOGETHER):
                self._add(new[i : i + TOGETHER])
        return numbers, counts

    def _add(self, words: list[str]) -> None:
        """Encode new words; `whole` tells whether both sides spell a word's bytes.

        Words that end in no white space are encoded together as one text, for
        no word's tokens depend on the next word.
        """
        joined = " ".join(words)
        if len(words) > 1 and "▁" not in joined and words[0] and words[0][0] != " " and words[-1] and not words[-1][-1].isspace() and _BLANK(joined) is None:
            text = np.frombuffer((" " + joined).encode(), np.uint8)
            stops = np.r_[np.flatnonzero(text == 0x20)[1:], len(text)]
            if len(stops) == len(words) and all(side.add_together(joined, text, stops) for side in (self.a, self.b)):
                self.whole.append(np.ones(len(words), bool))
                return
            for side in (self.a, self.b):
                side.forget(len(self.index) - sum(map(len, self.whole)), len(words))
        bodies = [(" " + w).encode() for w in words]
        whole = np.ones(len(words), bool)
        for side in (self.a, self.b):
            for i, (ids, body) in enumerate(zip(side.encode(words), bodies, strict=True)):
                own = np.array(ids, np.int32)
                side.keep(own, np.array([len(own)], np.int64))
                whole[i] &= side.bytes.joined(own).tobytes() == body
        self.whole.append(whole)


class _Numbers(dict):
    """Numbers of words in order of their first use; `new` collects those that have just got one."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


def _words(text: str) -> list[str]:
    """Words of a space and the text, each without the space that it starts with."""
    return text.split(" ") if text[0] != " " and _BLANK(text) is None else [w[1:] for w in _CUT(" " + text)]


@lru_cache(1)
def _tools(a_json: bytes, b_model: bytes) -> _Tokenizers:
    return _Tokenizers(a_json, b_model)


def _read(name: str | None, default: str) -> bytes:
    if name is None:
        import public_tokenizers

        name = public_tokenizers.path(default)
    with open(name, "rb") as f:
        return f.read()


def _sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][np.r_[0, np.cumsum(counts)]])


NUMBERS = T.ArrayType(T.IntegerType(), False)
LAYOUT = T.StructType([T.StructField(c, NUMBERS, False) for c in ("a_ends", "b_ends")])
GROUP = T.StructType([T.StructField("layout", T.IntegerType(), False), *(T.StructField(c, NUMBERS, False) for c in ("a_ids", "b_ids"))])


def tokenise(docs: DataFrame, *, text_col: str = "text", keep: list[str], a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """Pages (layouts, groups, words, docs): distinct end bytes; layout and ids of each distinct group; group numbers of each distinct word; the kept columns, n_a, n_b, n_groups and word numbers of each document.

    A page holds a few megabytes of text, or one long text. Null and empty
    texts, and those whose tokens' bytes on either side are not the text's, have
    no words.
    """
    ship(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kept = T.StructType([rows.schema[c] for c in keep])
    doc = T.StructType([*kept.fields, T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType(), False), T.StructField("words", NUMBERS)])
    shared = docs.sparkSession.sparkContext.broadcast((_read(a_file, A_FILE), _read(b_file, B_FILE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(*shared.value)
        for batch in batches:
            for part in slices(batch, "__text", PAGE):
                numbers, counts = tools.number(part.column("__text").to_pylist())
                whole = np.concatenate([*tools.whole, np.zeros(0, bool)])
                good = _sum_by(~whole[numbers], counts) == 0
                numbers, counts = numbers[np.repeat(good, counts)], np.where(good, counts, 0)
                used = np.zeros(len(tools.index), bool)
                used[numbers] = True
                distinct, own = np.flatnonzero(used), (np.cumsum(used) - 1)[numbers]
                (a_ids, a_ends, a_bounds), (b_ids, b_ends, b_bounds) = (side.flat_of(distinct) for side in (tools.a, tools.b))
                ends, bounds = _groups(a_ends, b_ends)
                held = np.searchsorted(bounds[0], a_bounds)  # a word ends where a group does
                first, which = _layouts([(a_ids, bounds[0]), (b_ids, bounds[1])])
                (a_ids, a_bounds), (b_ids, b_bounds) = _taken(a_ids, bounds[0], first), _taken(b_ids, bounds[1], first)
                sides = [_taken(e, b, first) for e, b in zip(ends, bounds, strict=True)]
                first, layout = _layouts(sides)
                layouts = pa.StructArray.from_arrays([_list(*_taken(e, b, first)) for e, b in sides], names=["a_ends", "b_ends"])
                groups = pa.StructArray.from_arrays([pa.array(layout.astype(np.int32)), _list(a_ids, a_bounds), _list(b_ids, b_bounds)], names=["layout", "a_ids", "b_ids"])
                words = _list(which.astype(np.int32), held)
                totals = [pa.array(_sum_by(n, counts)) for n in (tools.a.sizes(numbers), tools.b.sizes(numbers), np.diff(held)[own])]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(own.astype(np.int32)))
                each = pa.StructArray.from_arrays([*(part.column(c) for c in keep), *totals, lists], names=[*keep, "n_a", "n_b", "n_groups", "words"])
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([one(layouts), one(groups), one(words), one(each)], names=["layouts", "groups", "words", "docs"])
            give_back()

    return rows.mapInArrow(run, T.StructType([T.StructField("layouts", T.ArrayType(LAYOUT, False)), T.StructField("groups", T.ArrayType(GROUP, False)), T.StructField("words", T.ArrayType(NUMBERS, False)), T.StructField("docs", T.ArrayType(doc, False))]))


# --- alignment ---------------------------------------------------------------------------------------------------------


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _marked(m: Column, is_marked) -> Column:
    """Places in m of its elements v, at place p, with is_marked(v, p)."""
    return F.array_remove(F.transform(m, lambda v, p: F.when(is_marked(v, p), p).otherwise(-1)), -1)


def places(ends: Column, cuts: Column) -> Column:
    """For each cut, how many of the ends are at or before it. Both ascend, and every cut is an end.

    In the sorted union a cut stands right behind the equal end, so its place is
    the number of ends up to it and of the cuts before it.
    """
    return F.transform(_let(F.sort_array(F.concat(ends, cuts)), lambda m: _marked(m, lambda v, p: v == F.get(m, p - 1))), lambda p, k: p - k)


def overlaps(a_ends: Column, b_ends: Column) -> Column:
    """For each token of A, the first and last token of B that it overlaps, within a group: only the last ends of both sides are equal.

    In the sorted union, with A's end first among equal ones, the place of A's
    i-th end is i and the number of B's ends before it: that B token is its last.
    Its first is the one that the token of A before it overlapped last.
    """
    merged = F.sort_array(F.concat(F.transform(a_ends, lambda e: e * 2), F.transform(b_ends, lambda e: e * 2 + 1)))
    last = F.transform(_let(merged, lambda m: _marked(m, lambda v, p: v % 2 == 0)), lambda p, i: p - i)
    return _let(last, lambda n: F.transform(n, lambda j, i: F.struct(F.when(i == 0, 0).otherwise(F.get(n, i - 1)).alias("first"), j.alias("last"))))


def _layout(ends: Column) -> Column:
    """What groups of a layout have in common, or words of several groups: n_groups, order and marks (tokens as the groups' text has them, A's first, and what follows each), from and to (the places of each link).

    A token of B is numbered after all of A's.
    """
    a_ends, b_ends = ends["a_ends"], ends["b_ends"]
    made = lambda n, order, marks, a, b: F.struct(n.alias("n_groups"), order.alias("order"), marks.alias("marks"), a.alias("from"), b.alias("to"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    ended = lambda marks: F.concat(F.slice(marks, F.lit(1), F.size(marks) - 1), F.array(F.lit("")))  # noqa: E731  nothing follows the last token

    def even(n: Column) -> Column:
        pairs = F.flatten(F.transform(upto(n), lambda i: F.array(i, n + i)))
        marks = F.array_repeat(F.array(F.lit("|"), F.lit(";")), n)
        return made(n, pairs, ended(F.flatten(marks)), upto(n), upto(n))

    def group(p: Column, k: Column) -> Column:
        start = lambda at: F.when(k == 0, 0).otherwise(F.get(at, k - 1))
        return F.struct(start(p["a"]).alias("a0"), F.get(p["a"], k).alias("a1"), start(p["b"]).alias("b0"), F.get(p["b"], k).alias("b1"))

    def several(g: Column) -> Column:
        own = lambda e, x, y: F.slice(e, x + 1, y - x)
        spans = overlaps(own(a_ends, g["a0"], g["a1"]), own(b_ends, g["b0"], g["b1"]))
        return F.flatten(F.transform(spans, lambda o, i: F.transform(F.sequence(o["first"], o["last"]), lambda j: F.struct((g["a0"] + i).alias("a"), (g["b0"] + j).alias("b")))))

    def linked(g: Column) -> Column:
        one_a = F.transform(F.sequence(g["b0"], g["b1"] - 1), lambda j: F.struct(g["a0"].alias("a"), j.alias("b")))
        one_b = F.transform(F.sequence(g["a0"], g["a1"] - 1), lambda i: F.struct(i.alias("a"), g["b0"].alias("b")))
        return F.when(g["a1"] - g["a0"] == 1, one_a).when(g["b1"] - g["b0"] == 1, one_b).otherwise(several(g))

    def general(gs: Column) -> Column:
        n = F.size(a_ends)
        order = F.flatten(F.transform(gs, lambda g: F.concat(F.sequence(g["a0"], g["a1"] - 1), F.sequence(n + g["b0"], n + g["b1"] - 1))))
        commas = lambda x, y: F.array_repeat(F.lit(","), y - x - 1)
        marks = F.flatten(F.transform(gs, lambda g: F.concat(commas(g["a0"], g["a1"]), F.array(F.lit("|")), commas(g["b0"], g["b1"]), F.array(F.lit(";")))))
        return _let(F.flatten(F.transform(gs, linked)), lambda x: made(F.size(gs), order, ended(marks), x["a"], x["b"]))

    found = lambda cuts: _let(F.struct(places(a_ends, cuts).alias("a"), places(b_ends, cuts).alias("b")), lambda p: _let(F.transform(upto(F.size(p["a"])), lambda k: group(p, k)), general))
    return F.when(a_ends == b_ends, even(F.size(a_ends))).otherwise(_let(F.array_intersect(a_ends, b_ends), found))


def _filled(layout: Column, a_ids: Column, b_ids: Column, pair) -> Column:
    """n_groups, groups (text) and links of a group or word with this layout."""
    text = _let(F.concat(a_ids, b_ids).cast("array<string>"), lambda ids: F.array_join(F.zip_with(layout["order"], layout["marks"], lambda k, mark: F.concat(F.get(ids, k), mark)), ""))
    links = F.zip_with(layout["from"], layout["to"], lambda i, j: pair(F.get(a_ids, i), F.get(b_ids, j)))
    return F.struct(layout["n_groups"].alias("n_groups"), text.alias("groups"), links.alias("links"))


def align(pages: DataFrame, pair) -> DataFrame:
    """Documents of the pages: kept columns, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`) and links (pair(a, b) of every two tokens that overlap)."""
    kept = [c for c in pages.schema["docs"].dataType.elementType.names if c != "words"]
    taken = lambda values, numbers: F.transform(numbers, lambda i: F.get(values, i))

    def text_and_links(of: Column, numbers: Column) -> list[Column]:
        return [F.array_join(taken(of["groups"], numbers), ";").alias("groups"), F.flatten(taken(of["links"], numbers)).alias("links")]

    def columns(rows: Column, use) -> Column:
        """use(rows) as an array for each column, in place of structs."""
        return _let(rows, lambda found: _let(F.struct(*(found[c].alias(c) for c in ("groups", "links"))), use))

    def groups(layouts: Column) -> Column:
        return F.transform("groups", lambda g: _let(F.get(layouts, g["layout"]), lambda x: _filled(x, g["a_ids"], g["b_ids"], pair)))

    def words(of: Column) -> Column:
        return F.transform("words", lambda numbers: F.struct(*text_and_links(of, numbers)))

    def documents(of: Column) -> Column:
        return F.transform("docs", lambda d: F.struct(*(d[c].alias(c) for c in kept), *text_and_links(of, d["words"])))

    found = _let(F.transform("layouts", _layout), lambda layouts: columns(groups(layouts), lambda of: columns(words(of), documents)))
    # pages have documents always; `inline` would add a filter on their number, for which all would be worked out twice
    return pages.select(found.alias("docs")).select(F.inline_outer("docs"))


def align_documents(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, a_file: str | None = None, b_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Each document's alignment, and the corpus's pairs.

    First: the kept columns (doc_id by default) with n_a, n_b, n_groups, n_links,
    n_best (links whose pair is its A id's most frequent, ties included),
    count_sum (over links, of their pairs' counts) and groups_sha256. Second: a,
    b, n_docs, is_best of every pair of ids that a document links.

    Null and empty texts have no tokens, zeros and an empty groups_sha256; so
    have texts that a side does not spell byte for byte. Repeated rows count as
    documents of their own; an empty table gives empty results. Kept columns
    that have a result's name give way to it.
    """
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    keep = [c for c in (keep if keep is not None else ["doc_id"]) if c not in made]
    own = [F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)]
    import sentencepiece
    from tokenizers import Tokenizer

    width = sentencepiece.SentencePieceProcessor(model_proto=_read(b_file, B_FILE)).get_piece_size()
    small = Tokenizer.from_str(_read(a_file, A_FILE).decode()).get_vocab_size() * width < 1 << 31
    pages = tokenise(docs.select(*own, F.col(text_col).alias("__text")), text_col="__text", keep=[f"__c{i}" for i in range(len(keep))], a_file=a_file, b_file=b_file)
    found = align(pages, lambda a, b: (a if small else a.cast("long")) * width + b)
    sha = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    texts = stage(found.select(F.monotonically_increasing_id().alias("__row"), *(f"__c{i}" for i in range(len(keep))), "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), sha.alias("groups_sha256"), "links"), "aligned", compression="zstd")
    counts = texts.select(F.explode_outer(F.array_distinct("links")).alias("pair")).where("pair is not null").groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = stage(counts.select(F.expr(f"cast(pair div {width} as int)").alias("a"), "pair", "n_docs"), "pairs")
    tops = counts.groupBy("a").agg(F.max("n_docs").alias("top"))  # as many rows as A has ids at most
    pairs = stage(counts.join(F.broadcast(tops), "a").select("pair", "a", (F.col("pair") % width).cast("int").alias("b"), "n_docs", (F.col("n_docs") == F.col("top")).alias("is_best")), "pair-counts")
    links = texts.select("__row", F.explode("links").alias("pair"))
    met = links.join(sized(pairs.select("pair", "n_docs", "is_best"), PAIRS), "pair")
    sums = met.groupBy("__row").agg(F.sum(F.col("is_best").cast("long")).alias("n_best"), F.sum("n_docs").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = texts.drop("links").join(sums, "__row", "left")
    back = [F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*back, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), pairs.drop("pair")


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """align_documents of all documents."""
    return align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]
