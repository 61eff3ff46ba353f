"""Embedding near-duplicates by an epsilon grid order join.

Cosine >= c of unit vectors is a distance of at most e = sqrt(2 - 2c). Vectors
are projected on leading principal directions (of a bounded sample: the
directions only decide how much is skipped, never what is found), put on a grid
of cell width e there, and sorted by their cells. That order is cut into blocks
of about `block` vectors (a hot cell is dealt to several). Blocks meet at the
cells of the grid that they cover or adjoin, and a pair is joined unless their
boxes in the projection are farther apart than e; within the join, intervals of the sequence
are halved again and again, and pairs of intervals that are provably distant are
skipped. What is left is compared by cosine in double precision.

Equal vectors are one vector with a count before anything else, so copies cost
nothing. A joined pair of blocks gives each vector's number of links and a
spanning forest of its links, never the links themselves: within a dense group
the comparisons grow with the square of its size, its rows do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import partitions, sized, stage, table, unstage
from .graph import components

GRID, BOX, LEAF = 3, 16, 128
#: Cells are at least this wide, so that there are at most 18 ** GRID of them however close to 1 the cosine is.
LEAST_WIDTH = 1 / 8


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _basis(reps: DataFrame, dim: int, sample: int) -> np.ndarray:
    """Leading principal directions, as columns, of at most about `sample` vectors of this length."""
    rows = reps.where(F.size("embedding") == dim)
    total = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("embedding", F.lit(1)), F.lit(max(1, math.ceil(total / sample)))) == 0).select("embedding").limit(2 * sample).toArrow()
    x = _vectors(picked.column(0).combine_chunks(), dim) if picked.num_rows else np.zeros((0, dim))
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    x = x - x.mean(0) if len(x) else np.eye(dim)
    _, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, ::-1][:, : min(BOX, dim)].copy()


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links (row, column) of a boolean matrix's bipartite graph."""
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    sub = mask[np.ix_(rows, cols)]
    forest, out = _Forest(), []
    label = sub.argmax(1)  # rows that share a first column are linked through it
    for r in range(len(rows)):
        out.append((rows[r], cols[label[r]]))
        forest.join(r, len(rows) + int(label[r]))
    for c in range(len(cols)):
        hits = np.flatnonzero(sub[:, c])
        roots = np.array([forest.root(int(r)) for r in hits])
        for r in hits[np.unique(roots, return_index=True)[1]]:
            if forest.root(int(r)) != forest.root(len(rows) + c):
                forest.join(int(r), len(rows) + c)
                out.append((rows[r], cols[c]))
    return out


def join_blocks(a: dict, b: dict, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each vector of a and of b (counting copies) between the two blocks, and spanning links between vectors.

    A block has vec (unit vectors in sequence order), box (their projections),
    n (copies) and rep. same: the blocks are one, and a pair counts once.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    na, nb = np.zeros(len(a["rep"]), np.int64), np.zeros(len(b["rep"]), np.int64)
    forest = _Forest()

    def visit(a0: int, a1: int, b0: int, b1: int) -> None:
        p, q = a["box"][a0:a1], b["box"][b0:b1]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if gap @ gap > reach * reach:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            mask = a["vec"][a0:a1] @ b["vec"][b0:b1].T >= least
            if same and a0 == b0:
                np.fill_diagonal(mask, False)
            if not mask.any():
                return
            na[a0:a1] += mask @ b["n"][b0:b1]
            if not (same and a0 == b0):
                nb[b0:b1] += a["n"][a0:a1] @ mask
            for i, j in _forest_of(mask):
                forest.join(int(a["rep"][a0 + i]), int(b["rep"][b0 + j]))
            return
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        if same and a0 == b0:
            visit(a0, am, a0, am)
            visit(a0, am, am, a1)
            visit(am, a1, am, a1)
        elif a1 - a0 <= LEAF:
            visit(a0, a1, b0, bm)
            visit(a0, a1, bm, b1)
        elif b1 - b0 <= LEAF:
            visit(a0, am, b0, b1)
            visit(am, a1, b0, b1)
        else:
            for x0, x1 in ((a0, am), (am, a1)):
                visit(x0, x1, b0, bm)
                visit(x0, x1, bm, b1)

    if len(na) and len(nb):
        visit(0, len(na), 0, len(nb))
    if same:
        na, nb = na + nb, np.zeros_like(nb)
    return na, nb, [(x, forest.root(x)) for x in list(forest.up)]


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def link_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, block: int = 4096, sample: int = 4096) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    A vector that is null, empty, all zero, or holds a null or non-finite
    component links with nothing. Vectors of different lengths do not link. Rows
    that repeat an id are vectors of their own. Null ids take part in links but
    name no component while another id is there. Other columns are ignored, and
    an empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.elementType
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    peak = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    good = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & (peak > 0), F.lit(False))
    # divided by its largest component first, so that no square over- or underflows; only for vectors outside a safe range
    safe = F.when((peak > 1e100) | (peak < 1e-100), F.transform("embedding", lambda x: (x.cast("double") / peak))).otherwise(F.col("embedding").cast("array<double>"))
    usable = rows.where(good).select("id", "embedding", F.xxhash64("embedding").alias("h"))
    counted = usable.groupBy("h", "embedding").agg(F.count("*").alias("n"), F.min("id").alias("least_id"))
    reps = stage(counted.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    dims = [r[0] for r in reps.select(F.size("embedding")).distinct().collect()]
    shared = spark.sparkContext.broadcast({d: _basis(reps, d, sample) for d in dims})
    reach = math.sqrt(max(1e-12, 2 - 2 * cosine))
    width = max(reach, LEAST_WIDTH)
    single = element.typeName() == "float"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("safe")
            lens = np.array(column.value_lengths().to_pylist(), np.int64)
            cells = np.zeros((len(lens), GRID), np.int64)
            for d in np.unique(lens):
                at = np.flatnonzero(lens == d)
                x = _vectors(column.take(pa.array(at)), int(d))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                p = x @ shared.value[int(d)][:, :GRID]
                cells[at, : p.shape[1]] = np.floor(p / width)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), column, pa.array(lens.astype(np.int32)), *(pa.array(cells[:, k]) for k in range(GRID))], names=["rep", "n", "safe", "dim", "c0", "c1", "c2"])

    placed = stage(reps.select("rep", "n", safe.alias("safe")).mapInArrow(place, "rep long, n long, safe array<double>, dim int, c0 long, c1 long, c2 long"), "placed")
    # Cells in sequence order: at most (2 / width + 2) ** GRID of each vector length, whatever the number of vectors.
    cell = ["dim", "c0", "c1", "c2"]
    sequence = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*cell).agg(F.count("*").alias("size")).withColumn("first", F.coalesce(F.sum("size").over(sequence), F.lit(0)))
    within = F.pmod(F.xxhash64("rep"), F.col("size"))
    numbered = placed.join(sized(stage(cells, "cells")), cell).withColumn("block", F.floor((F.col("first") + within) / block)).drop("first", "size")

    def cut(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("c0", "c1", "c2", "rep")])
        d = group.column("dim")[0].as_py()
        safe_ = group.column("safe").combine_chunks()
        x = _vectors(safe_, d)
        box = x / np.linalg.norm(x, axis=1, keepdims=True) @ shared.value[d]
        ranges = [group.column(f"c{k}").to_numpy() for k in range(GRID)]
        vec = safe_.flatten().to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64)
        one = [group.column("block")[0].as_py(), d, [int(c.min()) for c in ranges], [int(c.max()) for c in ranges], box.min(0).tolist(), box.max(0).tolist(), _pack(group.column("rep").to_numpy()), _pack(group.column("n").to_numpy()), _pack(vec)]
        names = ["block", "dim", "lo", "hi", "low", "high", "rep", "n", "vec"]
        return pa.table({k: pa.array([v], pa.int32() if k == "dim" else None) for k, v in zip(names, one, strict=True)})

    kind = "block long, dim int, lo array<long>, hi array<long>, low array<double>, high array<double>, rep binary, n binary, vec binary"
    blocks = stage(numbered.groupBy("dim", "block").applyInArrow(cut, kind).withColumn("block", F.col("dim").cast("long") * (1 << 40) + F.col("block")), "blocks")
    unstage(placed)

    meta = blocks.select("block", "dim", "lo", "hi", "low", "high")

    def in_cells(rows: DataFrame, margin: int) -> DataFrame:
        """A row per cell of the grid that the block's range of cells, widened by margin, covers."""
        for k in range(GRID):
            rows = rows.withColumn(f"c{k}", F.explode(F.sequence(F.col("lo")[k] - margin, F.col("hi")[k] + margin)))
        return rows

    left = in_cells(meta, 0).select(F.col("block").alias("i"), *cell, F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    right = in_cells(meta, 1).select(F.col("block").alias("j"), *cell, F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    gaps = F.zip_with(F.zip_with("low_i", "high_j", lambda x, y: x - y), F.zip_with("low_j", "high_i", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g) <= (reach + 1e-9) ** 2
    pairs = stage(left.join(right, cell).where("i <= j").where(near).select("i", "j", "dim").distinct(), "block-pairs")
    side = lambda s: blocks.select(F.col("block").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "vec")))
    tasks = pairs.repartition(4 * partitions(spark), "i", "j").join(side("i"), "i").join(side("j"), "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.float32 if single else np.float64
        for batch in batches:
            for row in batch.to_pylist():
                base = shared.value[row["dim"]]

                def load(s: str) -> dict:
                    x = np.frombuffer(row[f"vec_{s}"], kind).astype(np.float64).reshape(-1, row["dim"])  # noqa: B023
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    return {"vec": x, "box": x @ base, "rep": np.frombuffer(row[f"rep_{s}"], np.int64), "n": np.frombuffer(row[f"n_{s}"], np.int64)}  # noqa: B023

                a = load("i")
                b = a if row["i"] == row["j"] else load("j")
                na, nb, links = join_blocks(a, b, a is b, cosine)
                x, y = np.flatnonzero(na), np.flatnonzero(nb)
                ends = np.array(links, np.int64).reshape(-1, 2)
                out = [np.r_[a["rep"][x], b["rep"][y], ends[:, 0]], np.r_[na[x], nb[y], ends[:, 1]], np.r_[np.ones(len(x) + len(y), bool), np.zeros(len(ends), bool)]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=["a", "b", "is_count"])

    found = stage(tasks.mapInArrow(compare, "a long, b long, is_count boolean"), "links")
    per_rep = found.where("is_count").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    label = components(found.where("not is_count").select("a", "b")).withColumnRenamed("node", "rep")
    named = reps.select("rep", "h", "embedding", "n", "least_id").join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    facts = named.join(per_rep, "rep", "left").join(least, "component").select("h", "embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    facts = stage(facts, "vector-facts")
    unstage(blocks, pairs)
    known = rows.where(good).withColumn("h", F.xxhash64("embedding")).join(facts, ["h", "embedding"]).select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = known.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_embeddings of all vectors at a cosine of 0.95; unusable vectors link with nothing."""
    return link_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
