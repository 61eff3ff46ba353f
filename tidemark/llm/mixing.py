"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and
share the corpus's words by weight; no target exceeds `most_copies` times its
source, and what a cap cuts off is shared again by weight among the others. That
is a water level: sorted by capacity over weight, the capped sources are a
prefix, found with running sums over one row per source.

Copies: a document's expected copies are its source's target over its source's
words (times the document's own weight, relative to its source's mean, if a
weight column is given). Their whole part is certain. For the fraction f a
random u gives the Pareto rank (u/(1-u)) / (f/(1-f)), and the lowest ranks of a
source are taken until its remaining words are used up, the last one if at
least half of it fits; a second round over those left that are short enough
fills what a long last one leaves open. u is a hash of seed, id and text, so that runs agree.

The cut is found without sorting a source: ranks fall into `bins` bins of
about equal shares of it, sums by (source, bin) locate the bin of the cut, and only that bin's
documents (1/bins of a source) are put in order. The plan keeps, for each
source, the last rank taken; any task can then tell a document's copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, WORD, stage, table, text_of

WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_copies: float = 3.0) -> DataFrame:
    """sizes: one row per source with source, source_size. Adds weight and target; one row per source is all it orders."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most_copies))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "level": (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
            "limit": F.col("cap") / F.col("weight"),
            "place": F.row_number().over(by_level),
        }
    )
    # The first source whose limit lies above the level that it and those after it share sets the level for all of them.
    level = F.min(F.when(F.col("limit") > F.col("level"), F.struct("place", "level"))).over(whole)["level"]
    return rows.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))).select("source", "source_size", "weight", "target")


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: int, keep: list[Column]) -> DataFrame:
    text = text_of(text_col)
    own = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    return docs.select(
        *keep,
        F.col(id_col).alias("__id"),
        F.col(source_col).cast("string").alias("__source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("__size"),
        own.alias("__own"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("__salt"),
    )


def _ranked(rows: DataFrame, plan: DataFrame, bins: int, most_copies: float) -> DataFrame:
    """Measured rows with their source's columns of plan, certain copies and Pareto rank (null: nothing left to draw)."""
    u = (F.shiftrightunsigned("__salt", 11).cast("double") + 0.5) / float(1 << 53)
    level = F.least(F.lit(float(most_copies)), F.col("target") / F.col("own_size"))
    usual = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.coalesce(level - F.floor(level), F.lit(0.5))))
    spread = F.col("odds") * usual / (1 - usual)  # without weights the odds of u itself, so that bins hold equal shares of a source
    expected = F.when(F.col("own_size") > 0, F.least(F.lit(float(most_copies)), F.col("target") / F.col("own_size") * F.col("__own"))).otherwise(0.0)
    return (
        rows.join(plan, F.col("__source").eqNullSafe(F.col("plan_source")), "left")
        .drop("plan_source")
        .withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("part", F.col("expected") - F.col("whole"))
        .withColumn("odds", F.when(F.col("part") > 0, (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))))
        .withColumn("rank", F.when(F.col("odds").isNotNull(), F.struct("odds", "__id", "__salt")))
        .withColumn("bin", F.least(F.floor(spread / (1 + spread) * bins), F.lit(bins - 1)).cast("int"))
        .drop("expected", "part")
    )


def _last_taken(open_rows: DataFrame) -> DataFrame:
    """source, last: the highest rank that a source takes. open_rows: __source, __size, rank, bin, rest."""
    rows = open_rows.where("rank is not null and rest > 0")
    per_bin = rows.groupBy("__source", "rest", "bin").agg(F.sum("__size").alias("words"))
    before = Window.partitionBy("__source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        per_bin.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .where(F.col("before") <= F.col("rest"))
        .groupBy("__source")
        .agg(F.max_by(F.struct("bin", "before"), "bin").alias("c"))
        .select(F.col("__source").alias("source"), F.col("c.bin").alias("cut_bin"), "c.before")
    )
    met = rows.join(stage(cut, "mix-cuts"), F.col("__source").eqNullSafe(F.col("source")))
    below = met.where("bin < cut_bin").select("source", "rank")
    edge = met.where("bin = cut_bin")
    in_order = Window.partitionBy("__source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("__size").over(in_order), F.lit(0))
    taken = edge.withColumn("ahead", ahead).where(F.col("ahead") + F.col("__size") / 2 <= F.col("rest")).select("source", "rank")
    return below.union(taken).groupBy("source").agg(F.max("rank").alias("last"))


def plan_mix(rows: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_copies: float = 3.0, bins: int = 4096) -> DataFrame:
    """Row per source: plan_source, source_size, own_size, target, and where the two rounds of its sample end."""
    sums = rows.groupBy("__source").agg(F.sum("__size").alias("source_size"), F.sum(F.col("__size") * F.col("__own")).alias("own_size"))
    goals = source_targets(sums.select(F.col("__source").alias("source"), "source_size"), weights=weights, most_copies=most_copies).select(F.col("source").alias("plan_source"), "source_size", "target")
    goals = goals.join(sums.select("__source", "own_size"), F.col("plan_source").eqNullSafe(F.col("__source"))).drop("__source")
    goals = stage(goals, "mix-goals")
    ranked = stage(_ranked(rows, goals, bins, most_copies), "mix-ranked")

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, F.col("plan_source").eqNullSafe(F.col("source")), "left").drop("source")

    certain = ranked.groupBy(F.col("__source").alias("source")).agg((F.first("target") - F.sum(F.col("__size") * F.col("whole"))).alias("rest"))
    goals = stage(joined(goals, certain), "mix-goals")
    with_plan = lambda plan: ranked.join(plan, F.col("__source").eqNullSafe(F.col("plan_source")))
    first = _last_taken(with_plan(goals.select("plan_source", "rest"))).withColumnRenamed("last", "last1")
    goals = stage(joined(goals, first), "mix-goals")
    # A document too long for what was left may end the first round; shorter ones further down the same order fill up.
    over = with_plan(goals.select("plan_source", "rest", "last1")).withColumn("taken", F.coalesce(F.col("rank") <= F.col("last1"), F.lit(False)))
    left = over.groupBy(F.col("__source").alias("source")).agg((F.first("rest") - F.sum(F.when(F.col("taken"), F.col("__size")).otherwise(0))).alias("rest2"))
    goals = stage(joined(goals, left), "mix-goals")
    open_rows = with_plan(goals.select("plan_source", "last1", F.col("rest2").alias("rest"))).where("rank > last1 or last1 is null").where("__size <= rest")
    second = _last_taken(open_rows).withColumnRenamed("last", "last2")
    return stage(joined(goals, second), "mix-plan")


def _copies() -> Column:
    first = F.coalesce(F.col("rank") <= F.col("last1"), F.lit(False))
    second = F.coalesce((F.col("__size") <= F.col("rest2")) & (F.col("rank") <= F.col("last2")), F.lit(False))
    return (F.coalesce("whole", F.lit(0)) + F.when(first | second, 1).otherwise(0)).cast("long")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, most_copies: float = 3.0, seed: int = 7, bins: int = 4096) -> DataFrame:
    """One row per row of docs: id_col, source, size, source_size, target, copies, taken.

    A null or empty text has size 0 and takes 0. A null source is a source of
    its own, last in order. Weights that are null or not positive count as 0:
    such a document is not taken. Rows that repeat an id and text tie and are
    taken or left together; every other tie of ranks is broken by id and text.
    No document takes more than most_copies times its size. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = stage(_measured(docs, id_col, text_col, source_col, weight_col, seed, []), "mix-sizes")
    plan = plan_mix(rows, weights=weights, most_copies=most_copies, bins=bins)
    ranked = _ranked(rows, plan, bins, most_copies).withColumn("copies", _copies())
    return ranked.select(F.col("__id").alias(id_col), F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("__size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, most_copies: float = 3.0, seed: int = 7, bins: int = 4096) -> DataFrame:
    """The mix itself: docs with each row repeated as often as mix_sources copies it.

    The plan has a row per source, so that texts are neither joined by document
    nor shuffled to take effect.
    """
    sizes = stage(_measured(docs, id_col, text_col, source_col, weight_col, seed, []), "mix-sizes")
    plan = plan_mix(sizes, weights=weights, most_copies=most_copies, bins=bins)
    own_names = [F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    ranked = _ranked(_measured(docs, id_col, text_col, source_col, weight_col, seed, own_names), plan, bins, most_copies)
    taken = ranked.withColumn("__copies", _copies().cast("int")).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_sources of all documents with production parameters; null texts have size 0, a null source is the last."""
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
