"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased; whatever is no letter counts as one separator
character. Bigrams and trigrams that hold a letter are hashed into `buckets`
features. Training counts (language, feature) on every labelled row: each task
adds up its own rows first, so what is shuffled is bounded by tasks x languages x
buckets, and no key is hot. The matrix of log probabilities has languages x
buckets cells whatever the corpus's size; it is broadcast, and each task scores
batches of texts by gathering the matrix at the features that occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import table
from .words import U64, give_back, pieces

BUCKETS = 1 << 15
UNKNOWN = "und"
SEGMENT = 1 << 20
ORDERS = (2, 3)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _segments(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points, text index and whether the position is new, for about SEGMENT characters at a time.

    A long text comes in several segments; each after the first repeats its
    last two characters as context, which are not new.
    """
    held: list[tuple[int, str, int]] = []
    size = 0
    reach = max(ORDERS) - 1

    def flush():
        lens = np.array([len(s) for _, s, _ in held])
        points = np.frombuffer("".join(s for _, s, _ in held).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.array([i for i, _, _ in held]), lens)
        new = np.ones(len(points), bool)
        at = np.cumsum(lens) - lens
        for a, (_, _, skip) in zip(at, held, strict=True):
            if skip:
                new[a : a + skip] = False
        return points, doc, new

    for i, text in enumerate(texts):
        low = (text or "").lower()
        for a in range(0, len(low), SEGMENT):
            skip = reach if a else 0
            held.append((i, low[a - skip : a + SEGMENT], skip))
            size += len(held[-1][1])
            if size >= SEGMENT:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def features(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text index (ascending) and feature of every n-gram that holds a letter."""
    for points, doc, new in _segments(texts):
        letter = _letters()[points]
        c = np.where(letter, points, 0x20).astype(np.uint64)
        for n in ORDERS:
            m = len(c) - n + 1
            if m <= 0:
                continue
            h = np.full(m, U64(n), np.uint64)
            some = np.zeros(m, bool)
            for k in range(n):
                h = (h ^ c[k : k + m]) * U64(0x9E3779B97F4A7C15)
                h ^= h >> U64(29)
                some |= letter[k : k + m]
            ok = np.flatnonzero(some & (doc[:m] == doc[n - 1 :]) & new[n - 1 :])
            yield doc[ok], ((h[ok] >> U64(20)) % U64(buckets)).astype(np.int64)


@dataclass
class Model:
    """languages in order, and log probabilities of features by language; prior: log shares of rows."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Best language's index (-1: none) and its posterior."""
        n = len(texts)
        total = np.tile(self.prior, (n, 1)).astype(np.float64) if n else np.zeros((0, len(self.languages)))
        seen = np.zeros(n, bool)
        for doc, feature in features(texts, self.weights.shape[1]):
            if len(doc):
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                seen[doc[first]] = True
                for k, row in enumerate(self.weights):
                    total[doc[first], k] += np.add.reduceat(row[feature].astype(np.float64), first)
        seen |= np.fromiter((bool(t) and len(t) == 1 and t.isalpha() for t in texts), bool, n)
        if not self.languages:
            return np.full(n, -1), np.zeros(n)
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return np.where(seen, best, -1), np.where(seen, share, 0.0)


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, buckets: int = BUCKETS) -> Model:
    """Counts over all rows of docs that have a language (and meet `where`); add-one smoothing."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & (where if where is not None else F.lit(True))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n_rows: dict[str, int] = {}
        for batch in batches:
            for part in pieces(batch, "text", 1 << 21):
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                names, which = np.unique(np.array(langs, object), return_inverse=True)
                for k, name in enumerate(names):
                    sums.setdefault(name, np.zeros(buckets, np.int64))
                    n_rows[name] = n_rows.get(name, 0) + int((which == k).sum())
                for doc, feature in features(texts, buckets):
                    both = np.bincount(which[doc] * buckets + feature, minlength=len(names) * buckets).reshape(len(names), buckets)
                    for k, name in enumerate(names):
                        sums[name] += both[k]
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1)), pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[row[at], n_rows[name]].astype(np.int64))],
                names=["lang", "feature", "n"],
            )

    counted = rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    table_ = np.zeros((len(langs), buckets))
    prior = np.zeros(len(langs))
    row = np.array([place[x] for x in counted.column("lang").to_pylist()], np.int64)
    feature, n = counted.column("feature").to_numpy(), counted.column("n").to_numpy()
    is_prior = feature < 0
    prior[row[is_prior]] = n[is_prior]
    table_[row[~is_prior], feature[~is_prior]] = n[~is_prior]
    weights = np.log(table_ + 1) - np.log(table_.sum(1, keepdims=True) + buckets)
    return Model(langs, weights.astype(np.float32), np.log(prior / prior.sum()) if len(langs) else prior)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with lang_pred and score.

    lang_pred is `und` with score 0 for a text that is null, empty or without a
    letter, and for all texts if nothing was learned; otherwise score is the
    posterior of the predicted language. A kept column named lang_pred or score
    gives way to the prediction. Equal texts get equal predictions.
    """
    ship(docs.sparkSession)
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    read = text_col if text_col in keep else "__text"  # a text that is kept crosses to Python once
    rows = docs.select(*keep, *([] if read == text_col else [F.col(text_col).alias(read)]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for part in pieces(batch, read, 1 << 21):
                best, score = m.score(part.column(read).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])
            give_back()

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learned_from(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 != 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify of all documents by a model that two thirds of the labelled ones train; und for texts without a letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, where=learned_from())
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, model, keep=["doc_id", "held_out"])
