"""Licence scan over a positional rare-token index.

Templates are licences and licence notices as word sequences. Document
frequencies of their words over the whole corpus give inverse document
frequencies; each template is indexed by its 2 * `rare_words` rarest words as
postings (template, position). Of every text the `rare_words` licence words that
are rarest in the corpus are looked up there for each template, and every posting
votes for the alignment (template, position in text - position in template). An
alignment that at least two different rare words share is verified: all of the
template's key phrases must stand, word for word and byte for byte, inside the
aligned range. The share of template words found at their aligned places is its
score.

The base phrases are looked up by their rarest word in the same way, at every
place where it occurs. The index and the frequencies have one row per template
word, whatever the corpus's size; texts are scanned in a map over the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .blocks import first_of
from .common import table
from .words import NOT_ALNUM, Words, pieces, words_of

#: Phrases and labels of the base scan.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, words of a notice or of a whole licence, phrases that must all stand in the aligned range.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        ("in compliance with the license", "apache org licenses"),
    ),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
        ("redistribute it and or modify it", "gnu general public license"),
    ),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ("for any purpose with or without fee is hereby granted",),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ("to alter it and redistribute it freely",),
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-attribution", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software", "released into the public domain"),
    ),
)


def words_in(texts: list[str]) -> Words:
    return words_of(pa.array(texts, pa.string()), fold=True, separators=NOT_ALNUM)


@dataclass
class Index:
    """Hashes of the rare words, their postings, and all templates and phrases as word hashes."""

    vocabulary: np.ndarray  # sorted hashes
    first: np.ndarray  # of each vocabulary word's postings
    template: np.ndarray
    position: np.ndarray
    templates: list[np.ndarray]
    labels: list[str]
    keys: list[list[tuple[str, np.ndarray, int]]]  # phrase, word hashes, index of its rarest word
    base: list[tuple[str, str, np.ndarray, int]]
    rarity: np.ndarray  # by vocabulary word: its place in order of document frequency
    rare_words: int


def _hashes(text: str) -> np.ndarray:
    return words_in([text]).hash


def vocabulary(templates=TEMPLATES, base=BASE_PHRASES) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t) for _, t, _ in templates] + [_hashes(p) for p, _ in base]))


def build(frequency: dict[int, int], *, rare_words: int = 6, templates=TEMPLATES, base=BASE_PHRASES) -> Index:
    """frequency: documents of each template word's hash; words that are missing occur in none."""
    rarity = lambda hs: np.array([frequency.get(int(h), 0) for h in hs])
    seqs = [_hashes(t) for _, t, _ in templates]
    posts: list[tuple[int, int, int]] = []
    for k, seq in enumerate(seqs):
        # words that no text has can be nobody's rarest
        distinct = sorted(set(seq.tolist()), key=lambda h: (frequency.get(h, 0) == 0, frequency.get(h, 0), h))[: 2 * rare_words]
        posts += [(int(h), k, p) for p, h in enumerate(seq.tolist()) if h in distinct]
    posts.sort()
    hashes = np.array([p[0] for p in posts], np.uint64)
    vocab, first = np.unique(hashes, return_index=True)
    in_order = np.lexsort((vocab, [frequency.get(int(h), 0) for h in vocab]))
    rarest = lambda hs: int(np.argmin(rarity(hs)))
    return Index(
        vocab,
        np.r_[first, len(posts)],
        np.array([p[1] for p in posts], np.int64),
        np.array([p[2] for p in posts], np.int64),
        seqs,
        [label for label, _, _ in templates],
        [[(p, h := _hashes(p), rarest(h)) for p in keys] for _, _, keys in templates],
        [(label, p, h := _hashes(p), rarest(h)) for p, label in base],
        np.argsort(in_order),
        rare_words,
    )


def phrase_places(w: Words, phrase: str, hashes: np.ndarray, rare: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Word indexes in [lo, hi) where the phrase starts, whole within one text; compared by bytes in the end."""
    hi = len(w.hash) if hi is None else hi
    n = len(hashes)
    at = np.flatnonzero(w.hash[lo:hi] == hashes[rare]) + lo - rare
    at = at[(at >= lo) & (at + n <= hi)]
    at = at[w.doc[at] == w.doc[at + n - 1]] if len(at) else at
    for k in range(n):
        at = at[w.hash[at + k] == hashes[k]]
    parts = [p.encode() for p in phrase.split()]
    same = [all(w.data[w.start[i + k] : w.end[i + k]].tobytes() == parts[k] for k in range(n)) for i in at]
    return at[np.array(same, bool)]


def scan(w: Words, index: Index, least_votes: int = 2) -> dict[str, list]:
    """Digest columns of each text of w."""
    n = w.n_docs
    bounds = w.bounds()
    base: list[set[str]] = [set() for _ in range(n)]
    found: list[set[str]] = [set() for _ in range(n)]
    score = np.zeros(n)
    n_base = np.zeros(n, np.int64)
    first, last = np.full(n, -1), np.full(n, -1)
    for label, phrase, hashes, rare in index.base:
        for i in phrase_places(w, phrase, hashes, rare):
            d = w.doc[i]
            p = i - bounds[d]
            base[d].add(label)
            n_base[d] += 1
            first[d] = p if first[d] < 0 else min(first[d], p)
            last[d] = max(last[d], p)
            score[d] = 1.0

    slot = np.searchsorted(index.vocabulary, w.hash)
    slot[slot == len(index.vocabulary)] = 0
    hit = np.flatnonzero(index.vocabulary[slot] == w.hash)
    if len(hit):
        word = slot[hit]
        count = index.first[word + 1] - index.first[word]
        each = np.repeat(np.arange(len(hit)), count)
        post = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + index.first[word][each]
        template, origin = index.template[post], hit[each] - index.position[post]
        # of each text's words that a template has, the rarest; (text, template) and word in one number
        n_words, longest = len(index.vocabulary), max(map(len, index.templates))
        pair = w.doc[hit[each]].astype(np.int64) * len(index.templates) + template
        ranked, back = np.unique(pair * n_words + index.rarity[word[each]], return_inverse=True)
        head = np.flatnonzero(first_of(ranked // n_words))
        place = np.arange(len(ranked)) - np.repeat(head, np.diff(np.r_[head, len(ranked)]))
        rare = place[back] < index.rare_words
        pairs, which = np.unique(pair[rare], return_inverse=True)
        key = np.unique((which * (len(w.hash) + longest) + origin[rare] + longest) * n_words + word[each][rare])
        start = np.flatnonzero(first_of(key // n_words))
        votes = np.diff(np.r_[start, len(key)])
        for x in key[start[votes >= least_votes]] // n_words:
            (d, k), at = divmod(int(pairs[x // (len(w.hash) + longest)]), len(index.templates)), int(x % (len(w.hash) + longest)) - longest
            seq = index.templates[k]
            lo, hi = max(bounds[d], at), min(bounds[d + 1], at + len(seq))
            if not all(len(phrase_places(w, p, h, r, lo, hi)) for p, h, r in index.keys[k]):
                continue
            found[d].add(index.labels[k])
            score[d] = max(score[d], (w.hash[lo:hi] == seq[lo - at : hi - at]).sum() / len(seq))
    return {
        "n_words": np.diff(bounds).astype(np.int64),
        "n_base": n_base,
        "first_word": [None if x < 0 else int(x) for x in first],
        "last_word": [None if x < 0 else int(x) for x in last],
        "base_labels": [",".join(sorted(x)) for x in base],
        "labels": [",".join(sorted(x | y)) for x, y in zip(base, found, strict=True)],
        "score": score,
    }


def word_frequencies(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Documents that hold each template word, over all of docs; as many rows as there are template words."""
    ship(docs.sparkSession)
    vocab = vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words_of(part.column("text"), fold=True, separators=NOT_ALNUM)
                slot = np.minimum(np.searchsorted(vocab, w.hash), len(vocab) - 1)
                hit = vocab[slot] == w.hash
                pairs = np.unique(w.doc[hit] * len(vocab) + slot[hit])
                total += np.bincount(pairs % len(vocab), minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocab))), pa.array(total)], names=["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(vocab[r["word"]]): r["n"] for r in rows}


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rare_words: int = 6, least_votes: int = 2) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, no labels and score 0. Repeated rows and
    ids are scanned each for themselves; other columns of docs are ignored. An
    empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(build(word_frequencies(rows), rare_words=rare_words))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                got = scan(words_of(part.column("text"), fold=True, separators=NOT_ALNUM), shared.value, least_votes)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(got[c], k) for c, k in zip(names, kinds, strict=True))], names=[id_col, *names])

    fields = [T.StructField(c, {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.float64(): T.DoubleType()}[k]) for c, k in zip(names, kinds, strict=True)]
    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *fields]))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_licenses of all documents with production parameters; null texts have no words."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
