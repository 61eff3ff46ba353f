"""Vectorised words and word n-gram fingerprints of Arrow text columns.

Words are runs of bytes that are not separators; every separator is ASCII, so a
UTF-8 text is cut at the same places as its code points are. A short word's
fingerprint is a polynomial over randomly tabulated bytes modulo 2**64 with a
final mix. Such polynomials collide on long words of a certain build, whatever
the table, so a word of over SHORT bytes gets a keyed cryptographic hash. A
second fingerprint has its own table, base and key. An n-gram's fingerprint is a
polynomial over its words' fingerprints. All work on short words is
numpy over the column's own buffer, in blocks of a fixed number of bytes, so
that memory beyond the column itself stays flat however long a text is.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20
#: Bytes of the longest word whose fingerprint is a polynomial.
SHORT = 32
_BASES = (U64(0x9E3779B97F4A7C15 | 1), U64(0xC2B2AE3D27D4EB4F | 1))
_STEP = U64(0xD1342543DE82EF95)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Everything in ASCII but digits and lower-case letters; apply after folding A-Z.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLES = tuple(mix(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) for k in range(2))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] | None = None


def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if _POWERS is None:
        _POWERS = {}
    if which not in _POWERS:
        base = _BASES[which]
        up = np.full(BLOCK_BYTES + 1, base, np.uint64)
        down = np.full(BLOCK_BYTES + 1, U64(_inverse(int(base))), np.uint64)
        up[0] = down[0] = 1
        _POWERS[which] = np.cumprod(up), np.cumprod(down)
    return _POWERS[which]


@dataclass
class Words:
    """Words of consecutive texts: byte positions in `data`, the text's index, and fingerprints."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int

    def bounds(self) -> np.ndarray:
        """First word of each text, and the number of all words."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def second(self) -> np.ndarray:
        """Fingerprints of the words that do not depend on `hash`."""
        return _hash_words(self.data, self.start, self.end, 1)

    def index_in_doc(self) -> np.ndarray:
        return np.arange(len(self.doc)) - self.bounds()[self.doc]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each text's offsets in them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Fingerprints of the words data[start:end], the first or the second one."""
    up, down = _powers(which)
    table = _TABLES[which]
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = start[i]
        j = int(np.searchsorted(end, a + BLOCK_BYTES, "right"))
        if j == i:  # one word longer than a block: add up its pieces
            total, scale = U64(0), U64(1)
            for p in range(int(a), int(end[i]), BLOCK_BYTES):
                piece = data[p : min(p + BLOCK_BYTES, int(end[i]))]
                part = (table[piece] * up[: len(piece)]).sum(dtype=np.uint64)
                with np.errstate(over="ignore"):
                    total, scale = total + part * scale, scale * up[BLOCK_BYTES]
            out[i] = total
            i += 1
            continue
        piece = data[a : end[j - 1]]
        prefix = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(table[piece] * up[: len(piece)], out=prefix[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (prefix[e] - prefix[s]) * down[s]
        i = j
    out = mix(out + (end - start).astype(np.uint64) * _STEP)
    key = which.to_bytes(8, "little")
    for i in np.flatnonzero(end - start > SHORT):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=key).digest(), "little")
    return out


def words_of(column: pa.Array, *, fold: bool = False, separators: np.ndarray = SPACE) -> Words:
    """Words of a text column; fold turns A-Z into a-z first."""
    data, offsets = text_buffer(column)
    if fold:
        data = FOLD[data]
    inside = ~separators[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    before[firsts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[firsts[firsts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, end, doc, _hash_words(data, start, end), len(column))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word's index and fingerprint of each run of n words within one text."""
    total = len(w.doc) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        acc *= _STEP
        acc += w.hash[k : k + total]
    keep = np.flatnonzero(w.doc[:total] == w.doc[n - 1 :])
    return keep, mix(acc[keep])


def give_back() -> None:
    """Hand memory that is free again back to the system: Python workers live on, and share it with others."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(table: pa.RecordBatch | pa.Table, column: str, most_bytes: int = 4 << 20):
    """Slices of whole rows holding about most_bytes of text each (one long text may be more)."""
    col = table.column(column)
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
    run = np.cumsum(size)
    i = 0
    while i < len(size):
        base = run[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(run, base + most_bytes, "right")))
        yield table.slice(i, j - i)
        i = j
