"""Track imports compared with what is held, their merge, and the reconciliation of two replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import metres_between, same_position


def diff(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """incoming with bucket (new, identical, conflict), distance in metres and the held row's values (held_*).

    Both have at, lat, lon, ele, track_id; held has one row per instant.
    """
    h = held.select(*(F.col(c).alias(f"held_{c}") for c in ("at", "lat", "lon", "ele", "track_id")))
    rows = incoming.join(h, F.col("at") == F.col("held_at"), "left")
    same = same_position(F.col("lat"), F.col("lon"), F.col("ele"), F.col("held_lat"), F.col("held_lon"), F.col("held_ele"))
    bucket = F.when(F.col("held_at").isNull(), "new").when(same, "identical").otherwise("conflict")
    return rows.withColumn("bucket", bucket).withColumn("distance", F.when(F.col("bucket") == "conflict", metres_between(F.col("lat"), F.col("lon"), F.col("held_lat"), F.col("held_lon"))))


def commit(incoming: DataFrame, held: DataFrame, default: str = "keep", overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged rows, and overrides that meet no conflict any more.

    default and overrides (at, choice) say `keep` or `replace`. The comparison is
    with held as it is now, never with an earlier preview.
    """
    rows = diff(incoming, held)
    spark = incoming.sparkSession
    overrides = overrides if overrides is not None else spark.createDataFrame([], "at long, choice string")
    o = overrides.select(F.col("at").alias("o_at"), "choice")
    chosen = rows.join(o, F.col("at") == F.col("o_at"), "left").withColumn("choice", F.coalesce("choice", F.lit(default)))
    taken = chosen.where((F.col("bucket") == "new") | ((F.col("bucket") == "conflict") & (F.col("choice") == "replace"))).select("at", "lat", "lon", "ele", "track_id")
    merged = held.select("at", "lat", "lon", "ele", "track_id").join(taken.select("at"), "at", "left_anti").unionByName(taken)
    stale = overrides.join(rows.where("bucket = 'conflict'").select("at"), "at", "left_anti")
    return merged, stale


def sync_plan(local: DataFrame, remote: DataFrame, local_gone: DataFrame, remote_gone: DataFrame) -> DataFrame:
    """id with flags pull, push, delete_here, delete_there, unsendable.

    local and remote have id, imported_at, has_text; the others id, deleted_at.
    A deletion only holds if it is younger than the import that it meets.
    """
    side = lambda df, p: df.select("id", F.lit(True).alias(f"{p}_has"), F.col("imported_at").alias(f"{p}_at"), F.col("has_text").alias(f"{p}_text"))
    gone = lambda df, p: df.groupBy("id").agg(F.max("deleted_at").alias(f"{p}_gone"))
    rows = side(local, "l").join(side(remote, "r"), "id", "full_outer").join(gone(local_gone, "l"), "id", "left").join(gone(remote_gone, "r"), "id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    here, there = yes(F.col("l_has")), yes(F.col("r_has"))
    drop_here = here & yes(F.col("r_gone") > F.col("l_at"))
    drop_there = there & yes(F.col("l_gone") > F.col("r_at"))
    only_here, only_there = here & ~there & ~drop_here, there & ~here & ~drop_there
    flags = {
        "pull": only_there & yes(F.col("r_text")),
        "push": only_here & yes(F.col("l_text")),
        "delete_here": drop_here,
        "delete_there": drop_there,
        "unsendable": (only_here & ~yes(F.col("l_text"))) | (only_there & ~yes(F.col("r_text"))),
    }
    return rows.select("id", *(v.alias(k) for k, v in flags.items()))
