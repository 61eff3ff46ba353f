"""SentencePiece (BPE with byte fallback) encoding with seeded merge-dropout, and decoding.

Spaces become U+2581 and a text gets one in front. Symbols are merged in order
of the merged piece's score, then from the left. With dropout p, each candidate
merge is skipped for good if a hash keyed by the seed, the document's id, the
word's place in it, the word, the candidate's place and its piece falls below p,
so a text gets another segmentation for another seed and the same one in every
run. Every occurrence draws for itself. All that its segmentation depends on is
which of the pieces that the word has anywhere are skipped, so occurrences of a
batch with the same word and the same skipped pieces are segmented once.
`variants` above 0 takes the draw of an occurrence modulo that many.

No piece of such a vocabulary reaches across the start of a word, so words are
independent. The pieces that a batch's different short words have anywhere are
found once, by a trie, and stand in a table by word, place and length: a merge
is a look into it. Short words of about one length are merged together, one
merge of each per round, with numpy; a word of over LONG symbols goes through an
agenda (a heap) of its own. Characters outside the vocabulary, and U+2581 itself where a text
has it, become byte pieces; decoding therefore gives every text back exactly.
The vocabulary is read once by the driver and broadcast (its size is fixed).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import table
from .words import U64, give_back, mix, text_buffer
from .words import pieces as slices

#: Where the vocabulary file lies unless a caller says otherwise.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
ESCAPED = 0x110000  # stands for a U+2581 that the text itself has
LONG = 64
NONE = np.int32(2**31 - 1)
PLACE = 7  # bits of a short word's place beside a rank
LENGTHS = np.array([4, 6, 8, 10, 12, 16, 24, 40, LONG])  # words up to each are merged together
CELLS = 1 << 20  # of the tables of words that are merged together
SEGMENT = 1 << 19
HASHED = 1 << 17  # characters whose prefix sums are hashed together
_START = re.compile("(?<=[^ ]) ")
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


@dataclass
class Vocabulary:
    """Lookup tables made from a model; symbols from `size` on are characters (size + code point) outside it."""

    size: int
    of_char: np.ndarray  # code point -> symbol
    keys: np.ndarray  # left << 21 | right, sorted
    merged: np.ndarray
    rank: np.ndarray
    joins: np.ndarray  # code point -> occurs in a piece of two or more characters
    byte_ids: np.ndarray
    body: np.ndarray  # bytes of all pieces as decoded
    body_start: np.ndarray
    body_len: np.ndarray
    longest: int  # characters of the longest piece
    rank_of: np.ndarray  # piece -> rank << PLACE; the last, for -1, is above all
    root: np.ndarray  # code point -> trie node of the pieces that begin with it, 0: none
    edges: np.ndarray  # hashed: node << 21 | code point, -1: free
    below: np.ndarray  # the edge's node
    piece_of: np.ndarray  # node -> piece of two or more characters, or -1
    inner: np.ndarray  # node -> longer pieces begin with it


@dataclass
class Found:
    """The pieces of two or more characters in each different short word, by word, place (from 1) and length; -1: none."""

    points: np.ndarray
    start: np.ndarray  # by word
    size: np.ndarray
    table: np.ndarray
    base: np.ndarray  # by word, where its part of the table begins
    first: np.ndarray  # by word, its first piece's number
    count: np.ndarray
    cell: np.ndarray  # by piece, where it stands in its word's part
    salt: np.ndarray
    blocks: list[tuple[int, int, int, int]]  # words from, to, their places and cells of a place


def _codes(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + U64(1))


def _group(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different key stands first, and each key's number among them."""
    found = pa.array(key).dictionary_encode()
    back = found.indices.to_numpy()
    where = np.empty(len(found.dictionary), np.int64)
    where[back[::-1]] = np.arange(len(key) - 1, -1, -1)
    return where, back


def _slots(edges: np.ndarray, size: int) -> np.ndarray:
    """Where the search for edges begins in a table of so many."""
    return (edges.astype(np.uint64) * _C1 >> U64(65 - size.bit_length())).astype(np.int64)


@lru_cache(1)
def load(model: bytes) -> Vocabulary:
    """The model's tables; a worker makes them once, not for each task."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = sp.get_piece_size()
    normal = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    if any("▁" in p.lstrip("▁") for p in normal):
        raise ValueError("a piece reaches across the start of a word")
    of_char = np.arange(size, size + 0x110001, dtype=np.int32)
    for p, i in normal.items():
        if len(p) == 1:
            of_char[ord(p)] = i
    score = {p: sp.get_score(i) for p, i in normal.items()}
    order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    symbol = lambda p: normal[p] if p in normal else (size + ord(p) if len(p) == 1 else None)
    rows = []
    joins = np.zeros(0x110001, bool)
    for p, i in normal.items():
        if len(p) > 1:
            joins[[ord(c) for c in p]] = True
        for k in range(1, len(p)):
            left, right = symbol(p[:k]), symbol(p[k:])
            if left is not None and right is not None:
                rows.append((left << 21 | right, i, order[score[p]]))
    rows.sort()
    byte_ids = np.zeros(256, np.int32)
    bodies = [b""] * size
    for i in range(size):
        if sp.is_byte(i):
            b = int(sp.id_to_piece(i)[3:5], 16)
            byte_ids[b], bodies[i] = i, bytes([b])
    for p, i in normal.items():
        bodies[i] = p.replace("▁", " ").encode()
    lens = np.array([len(b) for b in bodies], np.int64)
    cols = [np.array(c, k) for c, k in zip(zip(*rows, strict=True), (np.int64, np.int32, np.int32), strict=True)]
    longest = max(map(len, normal), default=0)
    rank_of = np.full(size + 1, NONE >> PLACE << PLACE, np.int32)
    root, nodes = np.zeros(0x110001, np.int32), {(0, -1): 0}
    piece_of = {}
    for p, i in normal.items():
        rank_of[i] = order[score[p]] << PLACE
        if len(p) > 1:
            node = 0
            for c in p:
                node = nodes.setdefault((node, ord(c)), len(nodes))
            piece_of[node] = i
    room = 1 << (4 * len(nodes)).bit_length()
    edges, below = np.full(room, -1, np.int64), np.zeros(room, np.int32)
    inner = np.zeros(len(nodes), bool)
    for (above, c), node in nodes.items():
        if not above:
            root[c] = node
            continue
        inner[above] = True
        at = int(_slots(np.array([above << 21 | c]), room)[0])
        while edges[at] >= 0:
            at = (at + 1) % room
        edges[at], below[at] = above << 21 | c, node
    return Vocabulary(
        size, of_char, *cols, joins, byte_ids, np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(lens) - lens, lens,
        longest, rank_of, root, edges, below, np.array([piece_of.get(k, -1) for k in range(len(nodes))], np.int32), inner,
    )


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    power = lambda base: np.cumprod(np.r_[U64(1), np.full(HASHED, base)].astype(np.uint64))
    return power(_C1), power(U64(pow(int(_C1), -1, 1 << 64)))


class Encoder:
    def __init__(self, vocab: Vocabulary, dropout: float = 0.1, seed: int = 0, variants: int = 0):
        self.v, self.seed, self.variants = vocab, seed, max(0, variants)
        self.limit = U64(min(int(dropout * 2**64), 2**64 - 1))
        self.always = dropout >= 1
        self.power, self.unpower = _powers()

    def _look(self, left: np.ndarray, right: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such merge, or skipped) and merged symbol of pairs."""
        v = self.v
        pair = left.astype(np.int64) << 21 | right
        at = np.searchsorted(v.keys, pair)
        at[at == len(v.keys)] = 0
        ok = v.keys[at] == pair
        if self.limit:
            u = mix(key + place.astype(np.uint64) * _C2 + v.merged[at].astype(np.uint64) * _C3)
            ok &= ~((u < self.limit) | self.always)
        return np.where(ok, v.rank[at], NONE), v.merged[at]

    def _step(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The trie's nodes one character below; 0: none."""
        v = self.v
        edge = node.astype(np.int64) << 21 | point
        at = _slots(edge, len(v.edges))
        got = v.edges[at]
        out = np.where(got == edge, v.below[at], 0)
        rest = np.flatnonzero((got != edge) & (got >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(v.edges) - 1)
            got = v.edges[at[rest]]
            hit = got == edge[rest]
            out[rest[hit]] = v.below[at[rest[hit]]]
            rest = rest[~hit & (got >= 0)]
        return out

    def _find(self, points: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> Found:
        """The pieces in words; kind: their place in LENGTHS, ascending; words beyond have none here."""
        v = self.v
        ends = np.searchsorted(kind, np.arange(len(LENGTHS)), "right")
        stride = np.minimum(LENGTHS, v.longest) + 2  # the last is for all lengths that no piece has
        blocks = [(int(a), int(b), int(n), int(k)) for a, b, n, k in zip(np.r_[0, ends[:-1]], ends, LENGTHS, stride, strict=True) if a < b]
        short = int(ends[-1])
        cells = np.zeros(len(start), np.int64)
        cells[:short] = ((LENGTHS + 1) * stride)[kind[:short]]
        base = np.cumsum(cells) - cells
        table = np.full(cells.sum(), -1, np.int32)
        count = size[:short]
        offset = np.cumsum(count) - count
        at = np.repeat(start[:short] - offset, count) + np.arange(count.sum())  # of each place, its character
        cell = np.repeat(base[:short] + stride[kind[:short]] * (1 - start[:short]), count) + np.repeat(stride[kind[:short]], count) * at
        left = np.repeat(start[:short] + count, count) - at
        node = v.root[points[at]]
        for n in range(2, v.longest + 1):
            more = np.flatnonzero(v.inner[node] & (left >= n))
            if not len(more):
                break
            at, cell, left = at[more], cell[more], left[more]
            node = self._step(node[more], points[at + n - 1])
            piece = v.piece_of[node]
            hit = np.flatnonzero(piece >= 0)
            table[cell[hit] + n] = piece[hit]
        cell = np.flatnonzero(table >= 0)
        first = np.searchsorted(cell, base)
        count = np.diff(np.r_[first, len(cell)])
        piece = table[cell]
        cell -= np.repeat(base, count)
        place = cell // np.repeat(np.r_[stride, 1][kind], count) - 1
        salt = place.astype(np.uint64) * _C2 + piece.astype(np.uint64) * _C3
        return Found(points, start, size, table, base, first, count, cell, salt, blocks)

    def _skipped(self, found: Found, word: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (occurrences of words, each with a key of its own) and the numbers of pieces that they skip."""
        count = found.count[word]
        order = np.argsort(-count.astype(np.int16), kind="stable")  # the k-th pieces of all rows that have so many are worked on together
        many = len(count) - np.cumsum(np.bincount(count))
        at, own = found.first[word[order]], own[order]
        for m in many[:-1].tolist():
            u = found.salt[at[:m]]
            u += own[:m]
            hit = np.arange(m) if self.always else np.flatnonzero(mix(u) < self.limit)
            yield order[hit], at[hit]
            at[:m] += 1

    def _merge_short(self, found: Found, word: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and row numbers after all merges of rows: words, ascending by block, each with a key."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        row = 0
        for a, b, places, stride in found.blocks:
            last = row + int(np.count_nonzero((word >= a) & (word < b)))
            part = (places + 1) * stride
            table = found.table[found.base[a] : found.base[a] + (b - a) * part].reshape(-1, part)
            while row < last:
                end = min(last, row + max(1, CELLS // part))
                sym, of = self._merge_block(found, table[word[row:end] - a], word[row:end], own[row:end], places, stride)
                out.append((sym, of + row))
                row = end
        return np.concatenate([np.zeros(0, np.int32), *(s for s, _ in out)]), np.concatenate([np.zeros(0, np.int64), *(r for _, r in out)])

    def _merge_block(self, found: Found, table: np.ndarray, word: np.ndarray, own: np.ndarray, places: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of rows of one block; table has their parts, and is changed. Arrays go by place, then row; place 0 is empty."""
        v = self.v
        n, part = table.shape
        if self.limit:
            for of, k in self._skipped(found, word, own):
                table[of, found.cell[k]] = -1
        rank = np.empty((places + 1, n), np.int32)  # with its place, of the merge of the symbols there and after it
        rank[0] = v.rank_of[-1]
        rank[1:] = v.rank_of[table.reshape(n, places + 1, stride)[:, 1:, 2].T]
        rank += np.arange(places + 1, dtype=np.int32)[:, None]
        after = np.repeat(np.arange(1, places + 3), n)  # where the next symbol begins; 0 where none begins any more
        before = np.repeat(np.arange(-1, places + 1), n)
        ranks, flat = rank.reshape(-1), table.reshape(-1)

        def look(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            return v.rank_of[flat[row * part + begin * stride + np.minimum(end - begin, stride - 1)]] + begin

        while True:
            best = rank.min(axis=0)
            row = np.flatnonzero(best < v.rank_of[-1])
            if not len(row):
                break
            here = best[row].astype(np.int64) & ((1 << PLACE) - 1)
            at = here * n + row
            gone = after[at] * n + row
            end = after[gone]
            to = end * n + row
            prior = before[at]
            after[at], after[gone], before[to] = end, 0, here
            ranks[gone] = v.rank_of[-1]
            ranks[at] = look(row, here, after[to])
            ranks[prior * n + row] = look(row, prior, end)
        left = after.reshape(-1, n)[1 : places + 1].T
        row, place = np.nonzero((left > 0) & (np.arange(places) < found.size[word][:, None]))
        length = left[row, place] - place - 1
        sym = np.where(length > 1, flat[row * part + (place + 1) * stride + length], v.of_char[found.points[found.start[word[row]] + place]])
        return sym, row

    def _merge_long(self, sym: np.ndarray, key: np.uint64) -> np.ndarray:
        """The same by an agenda of candidates in order of rank and place."""
        n = len(sym)
        sym = sym.tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        agenda: list[tuple[int, int, int, int, int]] = []

        def look(pairs: list[int]) -> None:
            if pairs:
                left = np.array([sym[i] for i in pairs], np.int64)
                right = np.array([sym[after[i]] for i in pairs], np.int64)
                ranks, merged = self._look(left, right, np.full(len(pairs), key), np.array(pairs))
                for i, r, m, a, b in zip(pairs, ranks.tolist(), merged.tolist(), left.tolist(), right.tolist(), strict=True):
                    if r < NONE:
                        heapq.heappush(agenda, (r, i, m, a, b))

        look(list(range(n - 1)))
        while agenda:
            _, i, m, a, b = heapq.heappop(agenda)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            look([k for k in (before[i], i) if k >= 0 and after[k] >= 0])
        return np.array([s for s in sym if s >= 0], np.int32)

    def _bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary become byte pieces."""
        v = self.v
        if not (sym >= v.size).any():
            return sym, word
        point = np.where(sym >= v.size, sym - v.size, 0)
        point[point == ESCAPED] = SPACE
        lens = np.where(sym < v.size, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
        first = np.cumsum(lens) - lens
        out = np.repeat(sym, lens)
        for n in (1, 2, 3, 4):
            at = np.flatnonzero((sym >= v.size) & (lens == n))
            p = point[at]
            for k in range(n):
                bits = p >> (6 * (n - 1 - k)) & 0x3F if n > 1 and k else p >> (6 * (n - 1))
                lead = 0x80 if k else (0, 0, 0xC0, 0xE0, 0xF0)[n]
                out[first[at] + k] = v.byte_ids[lead | bits]
        return out, np.repeat(word, lens)

    def _skips(self, found: Found, word: np.ndarray, size: np.ndarray, key: np.ndarray, own: np.ndarray) -> np.ndarray:
        """By occurrence of a word, a hash of the word and of its pieces that the occurrence skips; of a long word its own key."""
        mark = mix(found.salt)
        sums = np.zeros(len(key), np.uint64)
        for row, piece in self._skipped(found, word, own):
            sums[row] += mark[piece]
        return np.where(size > LONG, own, mix(key + sums))

    def encode(self, points: np.ndarray, doc: np.ndarray, salt: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids, their document numbers, and the number of words of each document.

        points: code points with spaces as SPACE; doc: document numbers, ascending;
        salt and first_word: by document, its hash and its first word's place.
        """
        v = self.v
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(salt), np.int64)
        apart = ~v.joins[points]
        space = points == SPACE
        cut = np.ones(len(points), bool)
        cut[1:] = (doc[1:] != doc[:-1]) | (space[1:] & ~space[:-1]) | apart[1:] | apart[:-1]
        start = np.flatnonzero(cut)
        size = np.diff(np.r_[start, len(points)])
        word_doc = doc[start]
        key = np.empty(len(start), np.uint64)
        code = _codes(points)
        i = 0
        while i < len(start):  # prefix sums in blocks; a word longer than a block is hashed alone
            j = max(i + 1, int(np.searchsorted(start, start[i] + HASHED // 2)))
            a, b = start[i], start[j - 1] + size[j - 1]
            if b - a <= HASHED:
                sums = np.r_[U64(0), np.cumsum(code[a:b] * self.power[: b - a])]
                s = start[i:j] - a
                key[i:j] = (sums[s + size[i:j]] - sums[s]) * self.unpower[s]
            else:
                for k in range(i, j):
                    key[k] = int.from_bytes(hashlib.blake2b(points[start[k] : start[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
            i = j
        key = mix(key + size.astype(np.uint64) * _C2)
        own = key
        words = np.bincount(word_doc, minlength=len(salt))
        where, word = _group(key)
        kind = np.where(size[where] > LONG, len(LENGTHS), np.searchsorted(LENGTHS, size[where])).astype(np.uint8)
        order = np.argsort(kind, kind="stable")
        where, kind = where[order], kind[order]
        word = np.argsort(order)[word]
        found = self._find(points, start[where], size[where], kind)
        if self.limit:
            place = np.arange(len(start)) + (first_word - np.cumsum(words) + words)[word_doc]
            draw = mix(salt[word_doc] + place.astype(np.uint64) * _C1)
            if self.variants:
                draw %= U64(self.variants)
            own = mix(mix(key + draw * _C3) + U64(self.seed * int(_C1) % 2**64))
            key = self._skips(found, word, size, key, own)
        where, back = _group(key)
        order = np.argsort(kind[word[where]], kind="stable")
        where = where[order]
        back = np.argsort(order)[back]
        unique, count = own[where], size[where]
        sym_, word_ = self._merge_short(found, word[where], unique)
        if (count > LONG).any():
            parts, names = [sym_], [word_]
            for k in np.flatnonzero(count > LONG):
                parts.append(self._merge_long(v.of_char[points[start[where[k]] : start[where[k]] + count[k]]], unique[k]))
                names.append(np.full(len(parts[-1]), k))
            sym_, word_ = np.concatenate(parts), np.concatenate(names)
        sym_, word_ = self._bytes(sym_, word_)
        count = np.bincount(word_, minlength=len(unique))
        offset = np.cumsum(count) - count
        each = count[back]
        at = np.repeat(offset[back] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return sym_[at], np.repeat(word_doc, each), words

    def encode_texts(self, texts: list[str | None], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and offsets; long texts go in segments that start at words, so that segments change nothing."""
        ids, docs = [], []
        held: list[tuple[int, str]] = []
        fill, first = 0, np.zeros(len(texts), np.int64)

        def flush() -> None:
            nonlocal held, fill
            body = "".join(s for _, s in held)
            points = np.frombuffer(body.encode("utf-32-le"), np.uint32).astype(np.int32)
            doc = np.repeat([i for i, _ in held], [len(s) for _, s in held])
            points[points == SPACE] = ESCAPED
            points[points == 0x20] = SPACE
            got, of, words = self.encode(points, doc, salts, first)
            ids.append(got)
            docs.append(of)
            first[:] += words  # the next segment's words count on from here
            held, fill = [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            rest = " " + text
            a = 0
            while a < len(rest):
                b = a + SEGMENT
                if b < len(rest):
                    c = a + len(rest[a : max(a, rest.rfind(" ", a, b))].rstrip(" "))  # where the last run of spaces begins
                    if c > a and rest[c] == " ":
                        b = c
                    else:
                        b = m.start() if (m := _START.search(rest, b)) else len(rest)
                held.append((i, rest[a:b]))
                fill += min(b, len(rest)) - a
                a = b
                if fill >= SEGMENT or a < len(rest):
                    flush()
        if held:
            flush()
        n = np.bincount(np.concatenate(docs), minlength=len(texts)) if docs else np.zeros(len(texts), np.int64)
        return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), np.r_[0, np.cumsum(n)]


def decode_ids(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; the space put in front is taken off again."""
    lens = v.body_len[ids]
    total = np.r_[0, np.cumsum(lens)]
    at = np.repeat(v.body_start[ids] - total[:-1], lens) + np.arange(total[-1])
    body, ends = v.body[at], total[offsets]
    some = ends[1:] > ends[:-1]
    keep = np.ones(len(body), bool)
    keep[ends[:-1][some]] = False
    return body[keep], ends - np.r_[0, np.cumsum(some)]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _id_salt(ids: pa.Array, seed: int) -> np.ndarray:
    raw = ids.cast(pa.string()).fill_null("").to_pylist()
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, key=seed.to_bytes(8, "little", signed=True)).digest(), "little") for x in raw], np.uint64)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, dropout: float = 0.1, seed: int = 0, variants: int = 0, model: str = MODEL) -> DataFrame:
    """The kept columns (the id by default) with ids, n_pieces, round_trip, decoded_sha256.

    round_trip says that decoding the ids gives the text's bytes again;
    decoded_sha256 is of the decoded bytes. A null or empty text has no pieces.
    Rows that repeat an id and text get the same pieces. A kept column that has
    a result's name gives way to it; an empty table gives an empty result.
    dropout 0 gives the vocabulary's one standard segmentation, 1 gives
    characters and bytes.
    """
    ship(docs.sparkSession)
    results = ["ids", "n_pieces", "round_trip", "decoded_sha256"]
    keep = [c for c in (keep if keep is not None else [id_col]) if c not in results]
    rows = docs.select(*keep, F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(_read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(shared.value), dropout, seed, variants)
        for batch in batches:
            for part in slices(batch, "__text", 1 << 21):
                text = part.column("__text")
                ids, offsets = encoder.encode_texts(text.to_pylist(), _id_salt(part.column("__id"), seed))
                body, ends = decode_ids(encoder.v, ids, offsets)
                data, own = text_buffer(text)
                bodies = [body[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                same = [x == data[a:b].tobytes() for x, a, b in zip(bodies, own[:-1], own[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in keep),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
                        pa.array(np.diff(offsets)),
                        pa.array(same, pa.bool_()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string()),
                    ],
                    names=[*keep, *results],
                )
                del ids, offsets, body, ends, bodies, data
                give_back()

    kinds = [T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType(), T.StringType()]
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(c, k) for c, k in zip(results, kinds, strict=True))]))


def decode(encoded: DataFrame, *, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """encoded with text_col (replaced if there) decoded from ids_col; null ids give an empty text.

    Ids outside the vocabulary are an error, as are bytes that are no UTF-8.
    """
    ship(encoded.sparkSession)
    keep = [c for c in encoded.columns if c != text_col]
    shared = encoded.sparkSession.sparkContext.broadcast(_read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(shared.value)
        for batch in batches:
            column = batch.column(ids_col)
            lens = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            body, ends = decode_ids(v, ids, np.r_[0, np.cumsum(lens)])
            texts = [body[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text_col])

    rows = encoded.select(*keep)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def op5_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode of all documents with dropout 0.1; null texts have no pieces."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
