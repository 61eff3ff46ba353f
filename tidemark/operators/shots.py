"""Files grouped into shots, their best file, fingerprints of sets, and new names."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import leading_number
from ..staging import with_place

#: Preference of file kinds for a shot.
KIND_RANK = {"jpeg": 0, "raw": 1, "video": 2, "other": 3}


def kind_rank(kind: Column) -> Column:
    out = F.lit(KIND_RANK["other"])
    for k, v in KIND_RANK.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def group_into_shots(assets: DataFrame, stem: str = "stem") -> DataFrame:
    """One row per stem, whatever its case: stem (least spelling), assets in order of preference, needs_derivation (the best is raw).

    assets has stem, kind, bytes and rel_path; other kinds of files are left out.
    """
    member = F.struct(kind_rank(F.col("kind")).alias("rank"), (-F.col("bytes")).alias("order"), "rel_path", "kind", "bytes")
    rows = assets.where(F.col("kind") != "other").groupBy(F.upper(stem).alias("key")).agg(F.min(stem).alias("stem"), F.array_sort(F.collect_list(member)).alias("assets"))
    return rows.withColumn("needs_derivation", F.col("assets")[0]["kind"] == "raw")


def best_asset(assets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best row of each key: kind, then size, then path; combined before the shuffle."""
    row = F.struct(*assets.columns)
    order = F.struct(kind_rank(F.col("kind")), -F.col("bytes"), "rel_path")
    return assets.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(row, order).alias("_r")).select("_r.*")


def set_fingerprint(rows: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """A hash of each key's tuples, whatever their order: sums of hashes, so that no task gathers a key's rows."""
    return rows.groupBy(*keys).agg(set_hash(tuple_line(F.col(p) for p in parts)).alias("fingerprint"), F.count("*").alias("n"))


def tuple_line(parts: Iterable[Column]) -> Column:
    """The parts as one text that no other parts have: each with its length in front, null as `-`."""
    text = [p.cast("string") for p in parts]
    return F.concat_ws("", *(F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in text))


def set_hash(line: Column) -> Column:
    """Aggregate: a hash of a group's lines that does not depend on their order."""
    digest = F.sha2(line, 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws(":", part(0), part(1)), 256)


def card_summaries(files: DataFrame, known: DataFrame, scope: str = "scope", stem: str = "stem") -> DataFrame:
    """scope, shots, new_shots, seen_before of cards; stems are compared whatever their case. known has the same two columns."""
    mine = files.select(F.col(scope), F.upper(stem).alias("_stem")).distinct()
    held = known.select(F.col(scope).alias("_scope"), F.upper(stem).alias("_held")).distinct()
    rows = mine.join(held, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("_stem") == F.col("_held")), "left")
    counted = rows.groupBy(scope).agg(F.count("*").alias("shots"), F.count_if(F.col("_held").isNull()).alias("new_shots"))
    seen = held.select("_scope").distinct()
    return counted.join(seen, F.col(scope).eqNullSafe(F.col("_scope")), "left").select(scope, "shots", "new_shots", F.col("_scope").isNotNull().alias("seen_before"))


def worth_announcing(summaries: DataFrame) -> DataFrame:
    """Cards with something new on them."""
    return summaries.where("new_shots > 0")


def first_rung(rungs: dict[str, tuple[Column, Column]]) -> Column:
    """struct<rung, value, reasons> of the first rung, in order, that has a value; rungs: name to (value, why not). Reasons of all that had none before it."""
    none = F.lit(None)
    value, name = none, none.cast("string")
    for k, (v, _) in reversed(list(rungs.items())):
        value, name = F.coalesce(v, value), F.when(v.isNotNull(), k).otherwise(name)
    tried, open_ = [], F.lit(True)
    for k, (v, why) in rungs.items():
        tried.append(F.when(open_ & v.isNull() & why.isNotNull(), F.concat(F.lit(f"{k}: "), why)))
        open_ = open_ & v.isNull()
    return F.struct(name.alias("rung"), value.alias("value"), F.array_join(F.array(*tried), "; ").alias("reasons"))


def content_copies(rows: DataFrame, content: str, ident: str) -> DataFrame:
    """ident, sha256, first_id and n of rows that share their content."""
    hashed = rows.select(ident, F.sha2(content, 256).alias("sha256"))
    firsts = hashed.groupBy("sha256").agg(F.min(ident).alias("first_id"), F.count("*").alias("n"))
    return hashed.join(firsts.where("n > 1"), "sha256").select(ident, "sha256", "first_id", "n")


def rename_plan(rows: DataFrame, *, name: str, capture: str, prefix: str, existing: DataFrame | None = None) -> DataFrame:
    """name, place, new_name, problem (collision, unchanged or null).

    Rows are numbered by capture (missing first), then the first number in the
    name, then the name; numbers are given before collisions are found, so gaps
    stay. The width is that of the largest number, two at least.
    """
    order = [F.col(capture).asc_nulls_first(), leading_number(F.col(name)).asc_nulls_first(), F.col(name)]
    numbered, total = with_place(rows, order)
    numbered = numbered.withColumn("place", F.col("place") + 1)
    width = max(2, len(str(total)))
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    out = numbered.withColumn("new_name", F.concat(F.lit(prefix + "-"), F.lpad(F.col("place").cast("string"), width, "0"), ext))
    taken = existing.select(F.col(name).alias("_taken")).distinct() if existing is not None else None
    out = out.join(taken, F.lower("new_name") == F.lower("_taken"), "left") if taken is not None else out.withColumn("_taken", F.lit(None))
    problem = F.when(F.col("new_name") == F.col(name), "unchanged").when(F.col("_taken").isNotNull(), "collision")
    return out.select(name, "place", "new_name", problem.alias("problem"))


def first_claimant(rows: DataFrame, target: str, order: Sequence[str]) -> DataFrame:
    """rows with claim: true for the first in order of those that claim one target, whatever its case."""
    firsts = rows.groupBy(F.lower(target).alias("_t")).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(firsts, F.lower(target) == F.col("_t")).withColumn("claim", F.struct(*order) == F.col("_first")).drop("_t", "_first")


def sample_evenly(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """n rows spread evenly over the order, both ends among them; all rows if there are no more."""
    numbered, total = with_place(rows, list(order), "__place")
    if total <= n:
        return numbered.drop("__place")
    picks = sorted({k * (total - 1) // max(1, n - 1) for k in range(n)})
    return numbered.where(F.col("__place").isin(picks)).drop("__place")
