"""Keyed merges of ledger tables: first or last writer wins, upserts, cascades, event folds.

Every merge is a pure function of the held table and the new rows; where to write the result, and when to swap it in, is
the caller's choice (see plans.snapshots).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import sized, stage, with_place


def _same(keys: Sequence[str], a: str, b: str):
    out = None
    for k in keys:
        c = F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        out = c if out is None else out & c
    return out


def one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in order; combined before the shuffle, so a hot key costs no more than others."""
    row = F.struct(*rows.columns)
    return rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def insert_or_ignore(held: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First writer wins: held rows stay, of several new rows of a key the first in order comes in."""
    fresh = one_per_key(new, keys, order).alias("n").join(held.select(*keys).distinct().alias("h"), _same(keys, "n", "h"), "left_anti")
    return held.unionByName(fresh)


def insert_or_replace(held: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Last writer wins: order is that of writing, reversed, so the row to keep comes first."""
    latest = one_per_key(new, keys, order)
    kept = held.alias("h").join(latest.select(*keys).alias("n"), _same(keys, "h", "n"), "left_anti")
    return kept.unionByName(latest)


def upsert(held: DataFrame, new: DataFrame, keys: Sequence[str], *, keep_old: Sequence[str] = (), keep_old_if_null: Sequence[str] = ()) -> DataFrame:
    """Update or insert: keep_old columns never change, keep_old_if_null only when the new value is not null. new has one row a key."""
    joined = held.alias("h").join(new.alias("n"), _same(keys, "h", "n"), "full_outer")
    there = F.coalesce(*(F.col(f"n.{k}").isNotNull() for k in keys))
    out = []
    for c in held.columns:
        h, n = F.col(f"h.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in keys or c in keep_old:
            out.append(F.coalesce(h, n).alias(c))
        elif c in keep_old_if_null or c not in new.columns:
            out.append(F.coalesce(n, h).alias(c))
        else:
            out.append(F.when(there, n).otherwise(h).alias(c))
    return joined.select(*out)


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign_key: str) -> tuple[DataFrame, DataFrame]:
    """parents and children without the keys in gone."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return parents.join(ids, F.col(key) == F.col("_gone"), "left_anti"), children.join(ids, F.col(foreign_key) == F.col("_gone"), "left_anti")


def delete_tracks(tracks: DataFrame, points: DataFrame, conflicts: DataFrame, tombstones: DataFrame, gone: DataFrame, now: int) -> dict[str, DataFrame]:
    """All four tables without the tracks in gone (id), which get a tombstone (id, deleted_at); removed: track_id and n of the points that go.

    A track that is not there gets no tombstone; one that has a tombstone gets a new one.
    """
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    without = lambda rows, key: rows.join(ids, F.col(key) == F.col("_gone"), "left_anti")
    fresh = tracks.join(ids, F.col("id") == F.col("_gone"), "left_semi").select("id", F.lit(now).cast("long").alias("deleted_at"))
    removed = points.join(ids, F.col("track_id") == F.col("_gone"), "left_semi").groupBy("track_id").agg(F.count("*").alias("n"))
    return {
        "tracks": without(tracks, "id"),
        "points": without(points, "track_id"),
        "conflicts": without(conflicts, "track_id"),
        "tombstones": insert_or_replace(tombstones.select("id", "deleted_at"), fresh, ["id"], ["id"]),
        "removed": removed,
    }


def fold_states(log: DataFrame, key: str, seq: str, columns: Sequence[str]) -> DataFrame:
    """The latest values of each key of an event log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("_s"), F.count("*").alias("n_events")).select(key, "_s.*", "n_events")


def batches_of(rows: DataFrame, order: Sequence, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """rows with batch: numbers from 0 that `size` rows share, in order, within keys (or over all rows)."""
    placed, _ = with_place(rows, [*keys, *order], "__place")
    if not keys:
        return placed.withColumn("batch", F.floor(F.col("__place") / size)).drop("__place")
    first = placed.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min("__place").alias("__first"))
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    return placed.join(sized(stage(first, "batch-starts")), on).withColumn("batch", F.floor((F.col("__place") - F.col("__first")) / size)).select(*rows.columns, "batch")


def published_among(hashes: DataFrame, published: DataFrame, key: str) -> DataFrame:
    return hashes.join(published.select(key).distinct(), key, "left_semi")


def unpublished(hashes: DataFrame, published: DataFrame, key: str) -> DataFrame:
    return hashes.join(published.select(key).distinct(), key, "left_anti")


def backoff_seconds(retry_after, attempt):
    """Seconds to wait: what was asked for, or 30 doubled up to four times; 30 at least."""
    return F.greatest(F.lit(30.0), F.coalesce(retry_after.cast("double"), 30 * F.pow(F.lit(2.0), F.least(attempt, F.lit(4)))))
