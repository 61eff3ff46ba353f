"""The row before or after in time, without a window over a whole key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_neighbour(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str], *, after: bool = False, bucket: int = 86_400) -> DataFrame:
    """rows with values (new name: column) of the row before it in its key, or after it; null at the end.

    order begins with a column of seconds. A key may have a third of all rows:
    windows run within (key, bucket of time), and only one row per bucket, its
    last or first, is carried to the next bucket that has rows. Rows with null
    seconds come first, in a bucket of their own.
    """
    parts = rows.withColumn("_bucket", F.floor(F.col(order[0]) / bucket))
    one = F.struct(*(F.col(c).alias(n) for n, c in values.items()))
    step = F.lead if after else F.lag
    near = parts.withColumn("_near", step(one).over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    place = F.struct(*order)
    end = F.min_by(one, place) if after else F.max_by(one, place)
    ends = parts.groupBy(*keys, "_bucket").agg(end.alias("_end"))
    carried = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_kb"), step("_end").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    on = F.col("_bucket").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    got = F.coalesce("_near", "_carried")
    return near.join(carried, on, "left").select(*rows.columns, *(got[n].alias(n) for n in values))
