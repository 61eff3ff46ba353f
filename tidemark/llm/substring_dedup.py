"""Substring deduplication over a log-structured fingerprint index.

A window is `window` consecutive words of a document; a word goes if some window
that covers it has a word sequence that also starts in a document with a smaller
id. Two windows can only be equal if their anchors are: a window's anchor is the
least fingerprint among its runs of `anchor` words, so that neighbouring windows
mostly share one, and about one anchor per five words has to be remembered.

The index holds sorted, immutable runs of anchors, one per batch, bucketed by
fingerprint range. A new batch writes its run, and the run is merged, range by
range and without a shuffle, with the run of the batches before it: anchors that
another document has too are contested, in the new batch and in the older blocks
alike. Both runs are then compacted into one. The index is a folder that can be
opened again, so that batches may come days apart.

Contested anchors are verified: all windows over them, and only those, are
compared by 96 bits of two fingerprints whose words are hashed independently, and the least id
of each window is handed back to the blocks that hold it. Questions and answers
travel by block (blocks.py), with one entry per block however often a passage
occurs in it.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..staging import _STAGED
from .blocks import ROW_BITS, Blocks, attach, first_of, ids_of, planes, split_ranges, unplanes
from .common import _delete, partitions, shared_dir, stage, table
from .words import U64, Words, give_back, mix, ngrams, words_of

RUN = "range int, hashes binary, which binary, many binary, blocks array<long>"
MARKS = "block long, range int, bits binary"


def _starts(w: Words, window: int) -> np.ndarray:
    return np.flatnonzero(w.doc[: max(0, len(w.doc) - window + 1)] == w.doc[window - 1 :])


def anchored(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window and the window's anchor."""
    at, h = ngrams(w, anchor)
    total = len(w.doc) - window + 1
    if not len(at) or total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = np.full(len(w.doc), np.iinfo(np.uint64).max)
    full[at] = h
    low = full[:total].copy()
    for k in range(1, window - anchor + 1):
        np.minimum(low, full[k : k + total], out=low)
    starts = _starts(w, window)
    return starts, low[starts]


def fingerprints(w: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent fingerprints of the windows: 64 bits, and 32 more."""
    total = max(0, len(w.doc) - window + 1)
    a, b = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    other = w.second()
    for k in range(window):
        a *= U64(0xD1342543DE82EF95)
        a += w.hash[k : k + total]
        b *= U64(0x9FB21C651E98DF25)
        b += other[k : k + total]
    return mix(a[starts]), (mix(b[starts]) >> U64(32)).astype(np.uint32)


def groups_of(f: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal pairs (f, g) side by side, and where each group starts in it."""
    order = np.argsort(f)
    fs, gs = f[order], g[order]
    start = np.flatnonzero(first_of(fs))
    if len(start) and (np.minimum.reduceat(gs, start) != np.maximum.reduceat(gs, start)).any():  # two windows under one f
        order = np.lexsort((g, f))
        start = np.flatnonzero(first_of(f[order]) | first_of(g[order]))
    return order, start


def _lists(group: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    return [unplanes(x, kind) for x in group.column(column).to_pylist()]


class FingerprintIndex:
    """Texts in blocks, one compacted run of anchors and the contested anchors of all batches, in one folder.

    The folder outlives the session unless it is dropped: `add` in another call,
    or in another program that opens the folder, merges a new batch with the
    history. A manifest names what belongs to the index; it is replaced last, so
    a batch that failed is not part of it and can be added again.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, *, window: int = 13, anchor: int = 6, block_bytes: int = 2 << 20):
        self.spark, self.block_bytes = spark, block_bytes
        self.root = (root or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}").rstrip("/")
        held = self._manifest()
        if root is None:
            _STAGED[self.root] = spark
        self.window, self.anchor, self.ranges = (held[k] for k in ("window", "anchor", "ranges")) if held else (window, anchor, partitions(spark))
        self.marks: list[str] = held["marks"] if held else []
        self.run: str | None = held["run"] if held else None
        self.version = held["version"] if held else -1
        self.spans: list[list[int]] = held["spans"] if held else []  # first and last block of each batch; others were left by batches that failed
        self.blocks = Blocks(spark, f"{self.root}/blocks", self.ranges)
        self.blocks.keep()

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def _manifest(self) -> dict | None:
        path, fs = self._fs()
        at = path(f"{self.root}/manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{names[-1]}", wholetext=True).first()[0]) if names else None

    def _commit(self) -> None:
        self.version += 1
        path, fs = self._fs()
        fresh, at = path(f"{self.root}/manifest-{self.version:09d}"), path(f"{self.root}/manifests/{self.version:09d}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps({"window": self.window, "anchor": self.anchor, "ranges": self.ranges, "marks": self.marks, "run": self.run, "spans": self.spans, "version": self.version}).encode()))
        out.close()
        fs.mkdirs(at.getParent())
        if not fs.rename(fresh, at):
            raise RuntimeError(f"another writer has committed version {self.version}")

    def _write(self, rows: DataFrame, spread: bool) -> str:
        """A run's folder; its files are bucketed by range."""
        at = f"{self.root}/run-{uuid.uuid4().hex}"
        name = attach(self.spark, at, RUN, "range", self.ranges)
        (rows.repartition(self.ranges, "range") if spread else rows).write.insertInto(name)
        self.spark.sql(f"DROP TABLE {name}")
        return at

    def _read(self, run: str) -> DataFrame:
        return self.spark.table(attach(self.spark, run, RUN, "range", self.ranges))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> None:
        """Take in a table of documents, in so many batches, each merged with all before it."""
        first = self.blocks.append(docs, id_col, text_col, self.block_bytes)
        block, gone = F.col("block"), []
        for k in range(batches):
            gone += self._merge((block >= first) & ((F.shiftright(block, ROW_BITS) + block) % batches == k))
        newest = self.blocks.table.agg(F.max("block")).first()[0]
        if newest is not None and newest >= first:
            self.spans.append([first, newest])
        self._commit()
        for run in gone:
            _delete(self.spark, run)

    def _live(self) -> Column:
        """Which blocks are part of the index."""
        return reduce(lambda a, b: a | b, (F.col("block").between(*span) for span in self.spans), F.lit(False))

    def _merge(self, only: Column) -> list[str]:
        """Merge the blocks that meet `only`; the runs that are not needed any more.

        The batch's run is written, merged with the history's and compacted
        with it, and what is contested is noted. Contested are anchors that several documents have, in the batch's blocks
        and in older ones alike: block, range, bits.
        """
        window, anchor, ranges, blocks = self.window, self.anchor, self.ranges, self.blocks

        def ask(row: dict) -> Iterator[pa.RecordBatch]:
            w = words_of(row["texts"])
            starts, low = anchored(w, window, anchor)
            doc = w.doc[starts]
            keep = first_of(low) | first_of(doc)  # neighbours mostly share theirs
            low, doc = low[keep], doc[keep]
            order = np.lexsort((doc, low))
            low, doc = low[order], doc[order]
            h, count = np.unique(low[first_of(low) | first_of(doc)], return_counts=True)  # once per document
            at = split_ranges(h, ranges)
            full = np.flatnonzero(np.diff(at))
            cut = lambda x: pa.array([planes(x[at[k] : at[k + 1]]) for k in full], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), cut(h), cut(np.zeros(len(h), np.uint32)), cut((count > 1).astype(np.uint8)), pa.array([[row["block"]]] * len(full), pa.list_(pa.int64()))],
                names=["range", "hashes", "which", "many", "blocks"],
            )

        new, old = self._write(blocks.run(ask, RUN, only), True), self.run

        def flat(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Fingerprints, blocks and marks of a range's runs, one after the other."""
            h, m = _lists(group, "hashes", np.uint64), _lists(group, "many", np.uint8)
            names = [np.array(x, np.int64)[i] for x, i in zip(group.column("blocks").to_pylist(), _lists(group, "which", np.uint32), strict=True)]
            return np.concatenate([np.zeros(0, np.uint64), *h]), np.concatenate([np.zeros(0, np.int64), *names]), np.concatenate([np.zeros(0, np.uint8), *m])

        def contested(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            h, block, many = (np.concatenate(x) for x in zip(flat(left), flat(right), strict=True))
            order = np.argsort(h, kind="stable")  # the runs are sorted already; this merges them
            size = np.diff(np.r_[np.flatnonzero(first_of(h[order])), len(h)])
            several = many > 0
            several[order] |= np.repeat(size > 1, size)
            by_block = np.argsort(block, kind="stable")  # a block's anchors are in order in its run
            start = np.flatnonzero(first_of(block[by_block]))
            bits = [np.packbits(x).tobytes() for x in np.split(several[by_block], start[1:])] if len(start) else []
            n = len(bits)
            return pa.table({"block": pa.array(block[by_block][start]), "range": pa.array([key[0].as_py()] * n, pa.int32()), "bits": pa.array(bits, pa.binary())})

        def compact(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            h, block, many = (np.concatenate(x) for x in zip(flat(left), flat(right), strict=True))
            order = np.lexsort((block, h))
            names, which = np.unique(block, return_inverse=True)
            return pa.table(
                {
                    "range": pa.array([key[0].as_py()], pa.int32()),
                    "hashes": pa.array([planes(h[order])], pa.binary()),
                    "which": pa.array([planes(which[order].astype(np.uint32))], pa.binary()),
                    "many": pa.array([planes(many[order])], pa.binary()),
                    "blocks": pa.array([names.tolist()], pa.list_(pa.int64())),
                }
            )

        fresh = self._read(new)
        pair = fresh.groupBy("range").cogroup((self._read(old) if old else fresh.limit(0)).groupBy("range"))
        marks = f"{self.root}/contested-{uuid.uuid4().hex}"
        pair.applyInArrow(contested, MARKS).write.parquet(marks)
        self.marks.append(marks)
        self.run = self._write(pair.applyInArrow(compact, RUN), False) if old else new
        return [old, new] if old else []

    def contested(self) -> DataFrame:
        return self.spark.read.schema(MARKS).parquet(*self.marks)

    def results(self) -> DataFrame:
        """id, n_words, n_removed, kept of all documents that the index holds."""
        self.blocks.table = self.spark.table(self.blocks.name).where(self._live())
        return _resolve(self.blocks, self.contested(), self.window, self.anchor, self.ranges)

    def drop(self) -> None:
        self.blocks.drop()
        _STAGED.pop(self.root, None)
        _delete(self.spark, self.root)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, anchor: int = 6, batches: int = 2, block_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept (words joined by one space).

    Words are runs of anything but space and U+0009 to U+000D. A null text has
    no words; a text of fewer than `window` words loses none. Rows that repeat an
    id do not take words from each other; a null id counts as larger than all
    others. Other columns are ignored; an empty table gives an empty result. Ids
    are longs.
    """
    ship(docs.sparkSession)
    index = FingerprintIndex(docs.sparkSession, window=window, anchor=anchor, block_bytes=block_bytes)
    index.add(docs, id_col, text_col, batches)
    out = index.results().withColumnRenamed("id", id_col)
    for path in (index.run, *index.marks):  # all that is read from now on is the blocks and what results() has staged
        _delete(index.spark, path)
    return out


def _resolve(blocks: Blocks, marks: DataFrame, window: int, anchor: int, ranges: int) -> DataFrame:
    """Contested anchors verified, and the words of repeated windows cut out."""

    def verify(row: dict) -> Iterator[pa.RecordBatch]:
        if not row["marks"]:
            return
        w = words_of(row["texts"])
        starts, low = anchored(w, window, anchor)
        h = np.unique(low)
        at = split_ranges(h, ranges)
        hot = np.zeros(len(h), bool)
        for x in row["marks"]:
            a, b = at[x["range"]], at[x["range"] + 1]
            hot[a:b] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
        starts = starts[hot[np.searchsorted(h, low)]]
        if not len(starts):
            return
        own, _ = ids_of(row)
        f, g = fingerprints(w, starts, window)
        ids = own[w.doc[starts]]
        order, start = groups_of(f, g)
        most, ids = np.maximum.reduceat(ids[order], start), np.minimum.reduceat(ids[order], start)
        f, g = f[order][start], g[order][start]
        at = split_ranges(f, ranges)
        full = np.flatnonzero(np.diff(at))
        cut = lambda x: pa.array([planes(x[at[k] : at[k + 1]]) for k in full], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), row["block"], np.int64)), cut(f), cut(g), cut(ids), cut((most > ids).astype(np.uint8))], names=["range", "block", "f", "g", "least", "many"])

    def owners(group: pa.Table) -> pa.Table:
        parts = [_lists(group, c, k) for c, k in (("f", np.uint64), ("g", np.uint32), ("least", np.int64), ("many", np.uint8))]
        lens = [len(x) for x in parts[0]]
        f, g, least, many = (np.concatenate(x) for x in parts)
        row = np.repeat(np.arange(len(lens)), lens)
        order, start = groups_of(f, g)
        first = np.empty(len(f), np.int64)
        first[order] = np.repeat(np.minimum.reduceat(least[order], start), np.diff(np.r_[start, len(f)]))
        told = (first < least) | (many > 0)  # a window that only its owner has needs no answer
        at = np.searchsorted(row[told], np.arange(len(lens) + 1))

        def cut(x: np.ndarray) -> pa.Array:
            x = x[told]
            return pa.array([planes(x[at[k] : at[k + 1]]) for k in range(len(lens))], pa.binary())

        out = pa.table({"block": group.column("block"), "range": group.column("range"), "f": cut(f), "g": cut(g), "first": cut(first)})
        give_back()
        return out

    asked = blocks.run(verify, "range int, block long, f binary, g binary, least binary, many binary", marks=marks)
    told = stage(asked.groupBy("range").applyInArrow(owners, "block long, range int, f binary, g binary, first binary"), "owners")

    def cut(row: dict) -> Iterator[pa.RecordBatch]:
        texts = row["texts"].fill_null("")
        w = words_of(texts)
        bounds = w.bounds()
        gone = np.zeros(len(w.doc), bool)
        if row["told"]:
            parts = sorted(row["told"], key=lambda x: x["range"])
            f, g, first = (np.concatenate([unplanes(x[c], k) for x in parts]) for c, k in (("f", np.uint64), ("g", np.uint32), ("first", np.int64)))
            starts = _starts(w, window)
            if len(f) and len(starts):
                a, b = fingerprints(w, starts, window)
                lo = np.searchsorted(f, a)
                found = np.zeros(len(starts), bool)
                own, _ = ids_of(row)
                ids = own[w.doc[starts]]
                live = np.arange(len(starts))
                while len(live):  # entries with one f lie side by side; nearly always there is one
                    live = live[lo[live] < len(f)]
                    live = live[f[lo[live]] == a[live]]
                    hit = g[lo[live]] == b[live]
                    found[live[hit]] = first[lo[live[hit]]] < ids[live[hit]]
                    live = live[~hit]
                    lo[live] += 1
                edge = np.zeros(len(w.doc) + 1, np.int64)
                edge[starts[found]] += 1  # each window starts once
                edge[starts[found] + window] -= 1
                gone = np.cumsum(edge)[:-1] > 0
        n = np.diff(bounds)
        removed = np.diff(np.r_[0, np.cumsum(gone)][bounds])
        kept = []
        for k, text in enumerate(texts.to_pylist()):
            words = text.encode().split()
            if removed[k]:
                words = itertools.compress(words, (~gone[bounds[k] : bounds[k + 1]]).tolist())
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([row["ids"], pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return blocks.run(cut, "id long, n_words long, n_removed long, kept string", told=told)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats of all documents, kept words as a digest; null texts have no words."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
