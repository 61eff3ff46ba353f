"""Reading the driver's tables, and what several operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..staging import delete as _delete
from ..staging import shared_dir, stage, unstage

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(rows: DataFrame, most_rows: int = 1 << 18) -> DataFrame:
    """A staged side of a join: broadcast up to most_rows (counted), else joined by a shuffled hash join."""
    return F.broadcast(rows) if rows.count() <= most_rows else rows.hint("shuffle_hash")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


__all__ = ["DOCUMENT_COLUMNS", "WORD", "_delete", "partitions", "shared_dir", "sized", "stage", "table", "text_of", "unstage"]
