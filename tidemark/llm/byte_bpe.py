"""Byte-level BPE encoding by prefix dynamic programming, appends and edits of encoded texts, and decoding.

A text is cut into words by the vocabulary's pattern; words are encoded on their
own. For every prefix of a word exactly one token can stand last in the prefix's
encoding: the token t that ends there and that stays as it is beside the last
token of the prefix before t. So one pass over a word's bytes stores each
prefix's last token, and walking back over them reads the encoding off. Because
a stored token depends on nothing that follows, an append goes on where the
prefixes end, and an edit works the words anew that it can touch and keeps the
rest.

Whether two tokens stay side by side is decided by undoing their merges, the
youngest first, while looking at the pair at the border: if that pair could have
been merged before the merge that is undone, it does not stay.

`encode` does this for all different words of a slice of rows at once: a trie
over the vocabulary gives the tokens that start at each byte, and prefixes of
equal length are settled together. Where a word is long or a text is edited,
candidates come from an Aho-Corasick automaton instead, a word at a time. Each
worker remembers a bounded number of pairs of tokens. There is no shuffle:
documents do not depend on each other.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import table
from .words import give_back, text_buffer
from .words import pieces as slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pairs of tokens that a worker remembers at most, and bytes of the longest word that is encoded together with others.
REMEMBERED, LONGEST = 1 << 19, 512
#: Bytes of words whose prefixes are worked out together, about.
BLOCK = 1 << 17
#: Places of the table that answers for pairs of many words at once, as a power of two.
PLACES = 20
#: A match of the pattern can depend on so many characters after its end ("'" followed by two letters).
AHEAD = 2


#: Classes of characters, and a character that stands for each.
REST, LETTER, NUMBER, BLANK = range(4)
SIGNS = "!a1 "


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def classes() -> tuple[np.ndarray, dict[int, str]]:
    """The class of each code point in the rank files' library, and the code points that this splitter's puts into another, with the sign of the class that counts.

    Both follow Unicode, in different versions.
    """
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    theirs, ours = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for kind, sign in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        theirs[_points(bytes(tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())] = sign
        ours[_points("".join(regex.findall(kind, every)))] = sign
    return theirs, {int(c): SIGNS[theirs[c]] for c in np.flatnonzero(theirs != ours)}


def _class_of(points: list[int]) -> str:
    """A character class of code points, as ranges."""
    cuts = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = [points[0], *(points[i + 1] for i in cuts)], [*(points[i] for i in cuts), points[-1]]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True)) + "]"


class Splitter:
    """Words of texts by a pattern; characters of `odd` count as the character that stands for them.

    With the classes of all code points given, whole columns are cut at once, by
    the rules of the public pattern.
    """

    def __init__(self, pattern: str, odd: dict[int, str], kinds: np.ndarray | None = None):
        self.words = regex.compile(pattern)
        self.kinds = kinds
        self.odd = odd
        self.any_odd = regex.compile(_class_of(sorted(odd))).search if odd else None
        self.latin = min(odd, default=0x100) > 0xFF

    def _plain(self, text: str) -> bool:
        if self.any_odd is None or text.isascii():
            return True
        try:
            text.encode("latin-1")
            return self.latin
        except UnicodeEncodeError:
            return self.any_odd(text) is None

    def split(self, text: str) -> list[str]:
        if self._plain(text):
            return self.words.findall(text)
        return [text[m.start() : m.end()] for m in self.words.finditer(text.translate(self.odd))]

    def column(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts (null: none) in their order, as bytes, and each text's bounds among them."""
        if self.kinds is None:
            rows = [self.split(t) if t else [] for t in texts.to_pylist()]
            return pa.array([w.encode() for w in chain.from_iterable(rows)], pa.large_binary()), np.cumsum([0, *map(len, rows)])
        data, offsets = text_buffer(texts)
        at = self._starts(data, offsets)
        ends = np.append(at, len(data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        return words, np.searchsorted(at, offsets)

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the public pattern's matches start, which leave out nothing, in texts that lie end to end."""
        if not len(data):
            return np.zeros(0, np.int64)
        char, kind, at = data, self.kinds[data], None
        firsts = offsets[:-1][np.diff(offsets) > 0]
        if (wide := np.flatnonzero(data >= 0xC0)).size:
            kind[wide] = self.kinds[_points(data[data >= 0x80].tobytes().decode())]
            at = np.flatnonzero((data & 0xC0) != 0x80)
            char, kind, firsts = data[at], kind[at], np.searchsorted(at, firsts)
        first = np.zeros(len(char) + 3, bool)
        first[firsts] = True
        start = first.copy()
        start[1 : len(char)] |= kind[1:] != kind[:-1]
        # The last of some white space stands alone before something else, which a space is joined to.
        blank = kind == BLANK
        turn = blank[:-1] & ~blank[1:] & ~first[1 : len(char)]
        start[: len(char) - 1] |= turn
        start[1 : len(char)] &= ~(turn & (char[:-1] == 0x20))
        # An apostrophe that starts a word takes one of the endings along, and nothing else.
        quote = np.flatnonzero((char == 0x27) & start[: len(char)])
        one, two = (np.append(char, np.zeros(3, np.uint8))[quote + k] for k in (1, 2))
        one = np.where(first[quote + 1], 0, one)
        short = quote[np.isin(one, list(b"stmd"))]
        pair = (one.astype(np.int64) << 8) | two
        long = quote[np.isin(pair, [int.from_bytes(e, "big") for e in (b"re", b"ve", b"ll")]) & ~first[quote + 2]]
        start[np.concatenate([short + 1, long + 1, long + 2])] = False
        start[np.concatenate([short + 2, long + 3])] = True
        found = np.flatnonzero(start[: len(char)])
        return found if at is None else at[found]

    def spans_from(self, text: str, start: int) -> Iterator[tuple[int, int]]:
        """Spans of the words from `start` on, which has to be the start of a word."""
        if not self._plain(text):
            text = text.translate(self.odd)
        return (m.span() for m in self.words.finditer(text, start))


def _last_merge(rank: dict[bytes, int], token: bytes) -> tuple[int, int] | None:
    """The two tokens that are merged last when the bytes of a token are."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        least, i = min(found)
        if least == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    if len(parts) > 2:
        raise ValueError(f"the merges never reach the token {token!r}")
    return (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else None


def last_merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    return {r: h for t, r in ranks.items() if (h := _last_merge(ranks, t))}


class PrefixEncoder:
    """Encodings of words, by the last tokens of their prefixes."""

    def __init__(self, ranks: dict[bytes, int], halves: dict[int, tuple[int, int]] | None = None):
        self.rank = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.halves = last_merges(ranks) if halves is None else halves
        self.longest = max(map(len, ranks))
        self.known: dict[tuple[int, int], bool] = {}
        self.answers = np.full(1 << PLACES, -1)  # pairs, each with whether it stays, at places that their hashes give
        by_id = [self.bytes_of.get(r) for r in range(max(self.bytes_of) + 1)]
        self.body = pa.array(by_id, pa.large_binary())
        self.number = pa.array([f"{r} " for r in range(len(by_id))], pa.large_binary())
        self.size = np.array([len(t or b"") for t in by_id])

    @cached_property
    def ends(self):
        """The automaton that finds the tokens which end at each byte."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for t, r in self.rank.items():
            found.add_word(t.decode("latin-1"), (r, len(t)))
        found.make_automaton()
        return found

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray]:
        """Each inner node's next nodes by byte (0: none), and each node's token (-1: none); inner nodes come first, the root is 0."""
        inner = sorted({t[:i] for t in self.rank for i in range(len(t))}, key=len)
        node = {p: i for i, p in enumerate(inner)}
        for t in self.rank:
            node.setdefault(t, len(node))
        after, token = np.zeros((len(inner), 256), np.int32), np.full(len(node), -1, np.int32)
        for p, i in node.items():
            if p:
                after[node[p[:-1]], p[-1]] = i
            token[i] = self.rank.get(p, -1)
        return after, token

    def stays(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are encoded as these two tokens."""
        before = 1 << 40  # merges of lower rank than this happen while both tokens are at the border
        while True:
            if self.rank.get(self.bytes_of[left] + self.bytes_of[right], 1 << 40) < before:
                return False
            if left > right and left in self.halves:
                before, left = left, self.halves[left][1]
            elif right in self.halves:  # of equal ranks the one on the left is merged first
                before, right = right + 1, self.halves[right][0]
            elif left in self.halves:
                before, left = left, self.halves[left][1]
            else:
                return True

    def _remember(self, pair: tuple[int, int]) -> bool:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = self.known[pair] = self.stays(*pair)
        return found

    def stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`stays` of many pairs."""
        pairs = left.astype(np.int64) << 31 | right
        places = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACES)).view(np.int64)
        answers = self.answers[places]
        out = (answers & 1).astype(bool)
        if (new := np.flatnonzero(answers >> 1 != pairs)).size:
            first, of = np.unique(pairs[new], return_index=True, return_inverse=True)[1:]
            some = zip(left[new[first]].tolist(), right[new[first]].tolist(), strict=True)
            found = np.array([self._remember(p) if (stays := self.known.get(p)) is None else stays for p in some])
            out[new] = found[of]
            self.answers[places[new[first]]] = pairs[new[first]] << 1 | found
        return out

    def last_tokens(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each byte of words that lie end to end, the last token of its word's prefix that ends there."""
        after, token = self.trie
        begin, stop = (np.repeat(x, np.diff(bounds)) for x in (bounds[:-1], bounds[1:]))
        at, end, node = np.arange(len(data)), np.arange(1, len(data) + 1), after[0][data]
        if (token[node] < 0).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        last = np.full(len(data), -1, np.int32)
        found = []
        while len(at):
            hit = np.flatnonzero(token[node] >= 0)
            a, e, t = at[hit], end[hit], token[node[hit]]
            whole = a == begin[a]  # a prefix that is a token is encoded as itself
            last[e[whole] - 1] = t[whole]
            found.append([x[~whole].astype(np.int32) for x in (a, e, t)])
            on = np.flatnonzero((node < len(after)) & (end < stop[at]))
            at, end, node = at[on], end[on], node[on]
            node = after[node, data[end]]
            on = np.flatnonzero(node)
            at, end, node = at[on], end[on] + 1, node[on]
        at, end, final = map(np.concatenate, zip(*found, strict=True))
        on = np.flatnonzero(last[end - 1] < 0)
        length = (end[on] - begin[at[on]]).astype(np.uint16)  # of the prefix
        on = on[np.argsort(length, kind="stable")]
        at, end, final = at[on], end[on], final[on]
        steps = np.cumsum(np.bincount(length)).tolist()
        for i, j in zip(steps, steps[1:], strict=False):
            if i < j:
                keep = self.stay(last[at[i:j] - 1], final[i:j])
                last[end[i:j][keep] - 1] = final[i:j][keep]
        return last

    def encode_column(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The encodings of all words one after the other, and each word's bounds in them. Different words are encoded once."""
        coded = words.dictionary_encode()
        data, offsets = text_buffer_of(coded.dictionary)
        sizes = np.diff(offsets)
        short = np.flatnonzero(sizes <= LONGEST)
        if len(short) < len(sizes):
            together, near = text_buffer_of(coded.dictionary.take(pa.array(short)))
        else:
            together, near = data, offsets
        cuts = np.unique(np.append(np.searchsorted(near, np.arange(0, near[-1], BLOCK)), len(short)))
        blocks = [self.last_tokens(together[near[i] : near[j]], near[i : j + 1] - near[i]) for i, j in zip(cuts, cuts[1:], strict=False) if near[i] < near[j]]
        last = np.concatenate([np.zeros(0, np.int32), *blocks])
        # Walk back over all words at once; the k-th list has the k-th tokens from the end.
        at, front, word, back = near[1:] - 1, near[:-1], short, []
        counts = np.zeros(len(sizes), np.int64)
        while (on := np.flatnonzero(at >= front)).size:
            front, word, t = front[on], word[on], last[at[on]]
            back.append((word, t))
            counts[word] += 1
            at = at[on] - self.size[t]
        alone = {int(i): self.encode(data[offsets[i] : offsets[i + 1]].tobytes()) for i in np.flatnonzero(sizes > LONGEST)}
        for i, own in alone.items():
            counts[i] = len(own)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(bounds[-1], np.int32)
        for k, (word, t) in enumerate(back, 1):
            ids[bounds[word + 1] - k] = t
        for i, own in alone.items():
            ids[bounds[i] : bounds[i + 1]] = own
        which = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(counts[which])])
        return ids[np.repeat(bounds[which] - ends[:-1], counts[which]) + np.arange(ends[-1])], ends

    def extend(self, last: list[int], word: bytes) -> list[int]:
        """`last` has the last token of each non-empty prefix of a front part of word; adds those of the longer prefixes."""
        size = len(last)
        start = max(0, size - self.longest + 1)
        seen, known, add = size - start, self.known, last.append
        for end, (token, length) in self.ends.iter(word[start:].decode("latin-1")):
            if end != seen:
                continue  # found already, and no other token can be last there
            if length <= end + start:
                pair = last[end + start - length], token
                stays = known.get(pair)
                if not (self._remember(pair) if stays is None else stays):
                    continue
            add(token)
            seen += 1
        if seen + start != len(word):
            raise ValueError("the vocabulary lacks a byte of the text")
        return last

    def read_off(self, last: list[int], start: int = 0, end: int | None = None) -> list[int]:
        """The encoding of the word whose prefixes' last tokens are last[start:end]."""
        ids, at = [], (len(last) if end is None else end)
        while at > start:
            token = last[at - 1]
            ids.append(token)
            at -= len(self.bytes_of[token])
        ids.reverse()
        return ids

    def encode(self, word: bytes) -> list[int]:
        """The encoding of a word. A token by itself is encoded as itself, for its merges reach it."""
        token = self.rank.get(word)
        return [token] if token is not None else self.read_off(self.extend([], word))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Vocabulary:
    """What workers need: ranks, pattern, odd characters. One encoder is made in each worker."""

    _made: dict[str, tuple[PrefixEncoder, Splitter]] = {}  # in each process

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            self.file = f.read()
        self.pattern = pattern or public_tokenizers.PATTERN
        kinds, self.odd = classes()
        cuts = np.flatnonzero(np.diff(kinds, prepend=255))
        self.kinds = (kinds[cuts], np.diff(cuts, append=len(kinds))) if self.pattern == public_tokenizers.PATTERN else None
        self.halves = last_merges(self._ranks())
        self.key = hashlib.sha256(self.file + self.pattern.encode()).hexdigest()

    def _ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, self.file.splitlines())}

    def tools(self) -> tuple[PrefixEncoder, Splitter]:
        if self.key not in Vocabulary._made:
            Vocabulary._made.clear()
            kinds = None if self.kinds is None else np.repeat(*self.kinds)
            Vocabulary._made[self.key] = PrefixEncoder(self._ranks(), self.halves), Splitter(self.pattern, self.odd, kinds)
        return Vocabulary._made[self.key]


def text_buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary column, and its rows' bounds in them."""
    return text_buffer(column.view(pa.large_string()))


def _lists(rows: list[array], kind: pa.DataType = pa.int32()) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.frombuffer(r, np.int32) for r in rows if r] or [np.zeros(0, np.int32)]), kind))


def _mapped(rows: DataFrame, keep: list[str], fields: list[T.StructField], work: Callable, vocabulary: Vocabulary, sized_by: str) -> DataFrame:
    """work(tools, part) gives the arrays of `fields` for each slice of rows; the kept columns go along."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = shared.value.tools()
        for batch in batches:
            for part in slices(batch, sized_by, 1 << 20):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *work(tools, part)], names=[*keep, *(f.name for f in fields)])
            give_back()

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *fields]))


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
HASHES = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, vocabulary: Vocabulary | None = None, with_ids: bool = True) -> DataFrame:
    """The kept columns (doc_id by default) with ids, n_tokens, ids_sha256 and decoded_sha256.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the
    bytes that the ids decode to. A null or empty text has no tokens and the
    hashes of nothing; strings of special tokens are plain text. Every row is
    encoded for itself: ties and repeated rows get equal results, an empty table
    gives an empty result. A kept column that has a result's name gives way to it.
    """
    fields = [IDS, *HASHES] if with_ids else HASHES
    keep = [c for c in (keep if keep is not None else ["doc_id"]) if c not in {f.name for f in fields}]
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def work(tools: tuple[PrefixEncoder, Splitter], part: pa.RecordBatch) -> list[pa.Array]:
        encoder, splitter = tools
        words, rows = splitter.column(part.column("__text"))
        ids, ends = encoder.encode_column(words)
        bounds = ends[rows]
        numbers, bodies = (_hashes(names.take(pa.array(ids)), bounds, cut) for names, cut in ((encoder.number, 1), (encoder.body, 0)))
        lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))] if with_ids else []
        return [*lists, pa.array(np.diff(bounds)), numbers, bodies]

    return _mapped(rows, keep, fields, work, vocabulary or Vocabulary(), "__text")


def _hashes(parts: pa.Array, bounds: np.ndarray, cut: int) -> pa.Array:
    """SHA-256 of each row's parts one after the other, without the last `cut` bytes; a row's parts are those between its bounds."""
    data, offsets = text_buffer_of(parts)
    ends = offsets[bounds].tolist()
    return pa.array([hashlib.sha256(data[i : max(i, j - cut)]).hexdigest() for i, j in zip(ends, ends[1:], strict=False)], pa.string())


LAST = T.StructField("last", T.ArrayType(T.IntegerType(), False))


def prefixes(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The kept columns (doc_id by default), text and last: for each byte of the text, the last token of its word's prefix that ends there.

    This is the state that `edited` works on; `tokens` reads encodings off it. A
    null text is empty.
    """
    keep = [c for c in (keep if keep is not None else ["doc_id"]) if c not in ("text", "last")]
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def work(tools: tuple[PrefixEncoder, Splitter], part: pa.RecordBatch) -> list[pa.Array]:
        encoder, splitter = tools
        out = []
        for text in part.column("text").to_pylist():
            last = array("i")
            for word in splitter.split(text):
                last.extend(encoder.extend([], word.encode()))
            out.append(last)
        return [_lists(out)]

    return _mapped(rows, [*keep, "text"], [LAST], work, vocabulary or Vocabulary(), "text")


def _safe_start(text: str, at: int) -> int:
    """The last place, AHEAD characters before `at` or earlier, where white space follows something else: a word ends there whatever comes later."""
    i = min(at - AHEAD, len(text) - 1)
    while i > 0 and not (text[i].isspace() and not text[i - 1].isspace()):
        i -= 1
    return max(i, 0)


def _edit(tools: tuple[PrefixEncoder, Splitter], text: str, last: array, at: int, gone: int, new: str) -> tuple[str, array, int]:
    """Text and last tokens after the characters [at, at + gone) became `new`, and how many last tokens were worked out for that."""
    encoder, splitter = tools
    changed = text[:at] + new + text[at + gone :]
    shift, safe = len(new) - gone, at + len(new)
    start = _safe_start(text, at)
    pos = len(text[:start].encode())  # in the old text's bytes
    out, worked = array("i", last[:pos]), 0
    old = splitter.spans_from(text, start)
    was, was_end = next(old, (len(text), len(text)))
    for a, b in splitter.spans_from(changed, start):
        own = []
        while was < a and was < at:
            pos += len(text[was:was_end].encode())
            was, was_end = next(old, (len(text), len(text)))
        if a == was and a < at:  # the same word up to the edit: its prefixes keep their last tokens
            own = last[pos : pos + len(text[a : min(at, b, was_end)].encode())].tolist()
        word = changed[a:b].encode()
        worked += len(word) - len(own)
        out.extend(encoder.extend(own, word))
        if b >= safe:
            while was_end < b - shift:
                was, was_end = next(old, (len(text), len(text)))
            if was_end == b - shift:  # a word of either text ends here, so all later ones are the old ones
                out.extend(last[len(text[:was_end].encode()) :])
                break
    return changed, out, worked


def edited(prefixed: DataFrame, *, at: str, gone: str, new: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """What `prefixes` gives, after an edit of each text; the other columns stay, n_worked tells how many last tokens were worked out.

    The columns named by at, gone and new say that `gone` characters from
    character `at` on (0-based; cut to the text, null: its end) become `new`. Null
    gone and new are 0 and empty. An append is an edit at the end. The pattern's
    matches must not reach from another character into white space.
    """
    own = ["text", "last", "n_worked"]
    keep = [c for c in prefixed.columns if c not in own]
    size = F.length("text")
    where = F.least(F.greatest(F.coalesce(F.col(at).cast("long"), size), F.lit(0)), size)
    some = F.greatest(F.coalesce(F.col(gone).cast("long"), F.lit(0)), F.lit(0))
    rows = prefixed.select(*keep, "text", "last", where.alias("__at"), F.least(some, size - where).alias("__gone"), F.coalesce(F.col(new).cast("string"), F.lit("")).alias("__new"))

    def work(tools: tuple[PrefixEncoder, Splitter], part: pa.RecordBatch) -> list[pa.Array]:
        found = [_edit(tools, t, array("i", x), i, g, n) for t, x, i, g, n in zip(*(part.column(c).to_pylist() for c in ("text", "last", "__at", "__gone", "__new")), strict=True)]
        return [pa.array([x for x, _, _ in found], pa.string()), _lists([x for _, x, _ in found]), pa.array([x for _, _, x in found], pa.int64())]

    fields = [T.StructField("text", T.StringType()), LAST, T.StructField("n_worked", T.LongType())]
    return _mapped(rows, keep, fields, work, vocabulary or Vocabulary(), "text")


def tokens(prefixed: DataFrame, *, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The columns besides text and last, with the ids that are read off the last tokens, word by word."""
    keep = [c for c in prefixed.columns if c not in ("text", "last", "ids")]

    def work(tools: tuple[PrefixEncoder, Splitter], part: pa.RecordBatch) -> list[pa.Array]:
        encoder, splitter = tools
        out = []
        for text, last in zip(part.column("text").to_pylist(), part.column("last").to_pylist(), strict=True):
            last, ids, pos = array("i", last), array("i"), 0
            for word in splitter.split(text):
                end = pos + len(word.encode())
                ids.extend(encoder.read_off(last, pos, end))
                pos = end
            out.append(ids)
        return [_lists(out)]

    return _mapped(prefixed.select(*keep, "text", "last"), keep, [IDS], work, vocabulary or Vocabulary(), "text")


def decode(encoded: DataFrame, *, ids_col: str = "ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """encoded with a binary column `decoded` (replaced if there): the bytes of the ids. Null ids give no bytes; unknown ids are an error."""
    keep = [c for c in encoded.columns if c != "decoded"]
    vocabulary = vocabulary or Vocabulary()
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = shared.value.tools()
        for batch in batches:
            bodies = [encoder.decode(ids or ()) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bodies, pa.binary())], names=[*keep, "decoded"])

    rows = encoded.select(*keep)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode of all documents, without the ids themselves."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
