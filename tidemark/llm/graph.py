"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage, unstage


#: Links that a task of a round takes at least; a small graph needs no more tasks than that makes, however many partitions the session has.
PER_TASK = 100_000


def _is_star(edges: DataFrame, tasks: int) -> bool:
    """Whether every node is either a centre or hangs on one centre only."""
    ends = edges.select(F.col("big").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("small", F.lit(0), F.lit(1)))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up > 1 or (up = 1 and down = 1)").coalesce(tasks).limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least reachable node) for every node of edges (a, b), which are longs.

    Self-links and repeated links change nothing; links with a null end are
    ignored; no links give no rows. Both steps only keep the least neighbour of
    a node, by partial aggregation; the joins that hand it on are on staged
    tables, so that adaptive execution can split a node with many links.
    Rounds grow with the logarithm of the longest chain; links that are stars
    already need none.
    """
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct()
    now = stage(tidy, "links")
    tasks = max(1, min(partitions(edges.sparkSession), math.ceil(now.count() / PER_TASK)))  # no round has more links than the one before
    while not _is_star(now, tasks):
        both = now.select(F.col("big").alias("x"), F.col("small").alias("y")).union(now.select(F.col("small").alias("x"), F.col("big").alias("y")))
        least = stage(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")).coalesce(tasks), "least")
        large = stage(both.where("y > x").join(least, "x").select(F.col("y").alias("big"), F.col("m").alias("small")).distinct().coalesce(tasks), "large-star")
        down = stage(large.groupBy("big").agg(F.min("small").alias("m")).coalesce(tasks), "least")
        met = large.join(down, "big")
        small = met.select("big", F.col("m").alias("small")).union(met.where("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))).distinct()
        after = stage(small.coalesce(tasks), "small-star")
        unstage(now, least, large, down)
        now = after
    roots = now.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    return now.select(F.col("big").alias("node"), F.col("small").alias("component")).union(roots)
