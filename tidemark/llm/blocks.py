"""Texts in numbered blocks, and fingerprints that travel by block.

A block is a row that holds the ids and texts of about `block_bytes` of text.
Blocks are stored once, as a table bucketed by block number in the shared
folder. Operators then ask questions about fingerprints ("how many documents
have this one?") with one row per block and fingerprint range, which holds the
block's sorted, distinct fingerprints; the answer comes back in the same order,
so that a few bits or bytes per fingerprint are enough. A fingerprint that a
third of all documents share is sent once per block, so no range is hot. Blocks
meet their answers by a join on the bucketed number: texts are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import _STAGED
from .common import _delete, partitions, shared_dir
from .words import U64, give_back

ROW_BITS = 20


SCHEMA = "block long, ids array<long>, texts array<string>"


def attach(spark: SparkSession, path: str, schema: str, column: str, n: int) -> str:
    """Name of a table of this session over files that are bucketed by column at path."""
    name = f"t_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({column}) INTO {n} BUCKETS")
    return name


class Blocks:
    """A stored table of blocks; `drop` removes it."""

    def __init__(self, spark: SparkSession, path: str | None = None, n: int | None = None):
        """An empty table at path (by default in the shared folder), or the one that is there, in n buckets."""
        self.spark, self.n = spark, n or partitions(spark)
        self.path = path or f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
        self.name = attach(spark, self.path, SCHEMA, "block", self.n)
        _STAGED[self.path] = spark
        self.table = spark.table(self.name)

    @classmethod
    def of(cls, docs: DataFrame, id_col: str, text_col: str, block_bytes: int = 2 << 20) -> Blocks:
        blocks = cls(docs.sparkSession)
        blocks.append(docs, id_col, text_col, block_bytes)
        return blocks

    def append(self, docs: DataFrame, id_col: str, text_col: str, block_bytes: int = 2 << 20) -> int:
        """Store docs in new blocks; the number of the first that there may be. Larger numbers are newer."""
        held = self.spark.table(self.name).agg(F.max("block")).first()[0]
        base = 0 if held is None else (held >> ROW_BITS) + 1
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = (base + TaskContext.get().partitionId()) << ROW_BITS
            ids: list[pa.Array] = []
            texts: list[pa.Array] = []
            size = count = 0

            def flush() -> pa.RecordBatch:
                nonlocal ids, texts, size, count, number
                i, t = pa.concat_arrays(ids), pa.concat_arrays(texts)
                ends = pa.array([0, len(i)], pa.int32())
                out = pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(ends, i), pa.ListArray.from_arrays(ends, t)], names=["block", "ids", "texts"])
                ids, texts, size, count, number = [], [], 0, 0, number + 1
                return out

            for batch in batches:
                i, t = batch.column("id"), batch.column("text")
                sizes = np.array(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False), np.int64)
                a = 0
                while a < len(sizes):
                    run = size + np.cumsum(sizes[a:])
                    b = a + max(1, int(np.searchsorted(run, block_bytes, "right")))
                    b = min(b, a + (1 << ROW_BITS) - count)
                    if ids and run[0] > block_bytes:
                        yield flush()
                        continue
                    ids.append(i.slice(a, b - a))
                    texts.append(t.slice(a, b - a))
                    size, count = size + int(sizes[a:b].sum()), count + b - a
                    if size >= block_bytes or count >= 1 << ROW_BITS or b < len(sizes):
                        yield flush()
                    a = b
            if ids:
                yield flush()
            give_back()

        rows.mapInArrow(pack, SCHEMA).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        self.table = self.spark.table(self.name)
        return base << ROW_BITS

    def keep(self) -> None:
        """The files stay when the program ends."""
        _STAGED.pop(self.path, None)

    def drop(self) -> None:
        self.keep()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.spark, self.path)

    def run(self, work: Callable[[dict], Iterator[pa.RecordBatch]], schema: str, only: Column | None = None, **given: DataFrame) -> DataFrame:
        """work over each block (or those that meet `only`), a dict of its columns, with a list per given table of that table's rows of the block.

        A given table has the column block; its other columns must not grow beyond the block's own size.
        """
        joined = self.table if only is None else self.table.where(only)
        for name, rows in given.items():
            others = [c for c in rows.columns if c != "block"]
            joined = joined.join(rows.groupBy("block").agg(F.collect_list(F.struct(*others)).alias(name)), "block", "left")

        names = list(given)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    row = {"block": batch.column("block")[k].as_py(), "ids": batch.column("ids")[k].values, "texts": batch.column("texts")[k].values}
                    row |= {name: batch.column(name)[k].as_py() or [] for name in names}
                    yield from work(row)
                    del row
                    give_back()

        return joined.mapInArrow(each, schema)


def ids_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The block's ids, null as the largest number, and which are null."""
    null = row["ids"].is_null().to_numpy(zero_copy_only=False)
    return row["ids"].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64), null


def planes(x: np.ndarray) -> bytes:
    """The bytes of an integer array, all most significant ones first: sorted numbers then compress well."""
    x = np.ascontiguousarray(x)
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, ::-1].T).tobytes()


def unplanes(body: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not body:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1)[::-1].T).reshape(-1).view(kind)


def split_ranges(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the 64-bit numbers begins in a sorted array; n + 1 places."""
    edges = np.array([(k << 64) // n for k in range(n)], np.uint64)
    return np.r_[np.searchsorted(sorted_hashes, edges), len(sorted_hashes)]


def first_of(values: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal values."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


__all__ = ["ROW_BITS", "U64", "Blocks", "attach", "first_of", "ids_of", "planes", "split_ranges", "unplanes"]
