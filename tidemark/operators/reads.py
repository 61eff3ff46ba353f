"""Reads of ledger tables: a filter, a projection and an order, all of which reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read(rows: DataFrame, where: Mapping[str, Any] | None = None, columns: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Rows by column: a value, a list of values, or (lo, hi) with both ends; null matches null. A name in order with `-` in front descends."""
    for name, want in (where or {}).items():
        c = F.col(name)
        if isinstance(want, tuple):
            rows = rows.where(c.between(*want))
        elif isinstance(want, list):
            rows = rows.where(c.isin(want))
        else:
            rows = rows.where(c.isNull() if want is None else c == want)
    by = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in order]
    rows = rows.selectExpr(*columns) if columns else rows
    return rows.orderBy(*by) if by else rows


def points_at(points: DataFrame, instants: DataFrame, at: str = "at") -> DataFrame:
    """Points at a table of instants."""
    return points.join(instants.select(at).distinct(), at, "left_semi")


def delete_range(rows: DataFrame, at: str, lo: int, hi: int) -> DataFrame:
    """rows without those from lo to hi, both ends gone too; null instants stay."""
    return rows.where(~F.coalesce(F.col(at).between(lo, hi), F.lit(False)))


def page(rows: DataFrame, order: Sequence[str | Column], first: int, n: int) -> DataFrame:
    """n rows from place `first` of a total order."""
    return rows.orderBy(*order).offset(first).limit(n)


def by_either_key(rows: DataFrame, library: DataFrame, name: str = "name", digest: str = "sha256") -> DataFrame:
    """rows with found: the library's id by digest, else by name whatever its case, the least of several."""
    by_digest = library.groupBy(F.col(digest).alias("_d")).agg(F.min("id").alias("_by_digest"))
    by_name = library.groupBy(F.lower(name).alias("_n")).agg(F.min("id").alias("_by_name"))
    out = rows.join(by_digest, F.col(digest) == F.col("_d"), "left").join(by_name, F.lower(name) == F.col("_n"), "left")
    return out.withColumn("found", F.coalesce("_by_digest", "_by_name")).drop("_d", "_n", "_by_digest", "_by_name")
