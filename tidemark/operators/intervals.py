"""Intervals that nest, from events that open and close them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nested_intervals(events: DataFrame, key: str, at: str, opens: str) -> DataFrame:
    """key, level, start, end of the intervals of each key: every closing event ends the newest one that is open.

    A closing event with nothing open, and an interval that nothing closes, give
    no row. Level 1 lies in no other. Running sums give each event its depth;
    within a level, opening and closing events alternate, so an interval's end
    is the next event of its level. Events of a key come at different instants;
    rows with a null in any of the columns are left out.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(opens).isNotNull())
    order = Window.partitionBy(key).orderBy(at)
    step = F.when(F.col(opens), 1).otherwise(-1)
    summed = rows.select(key, F.col(at).alias("start"), F.col(opens).alias("__opens"), F.sum(step).over(order).alias("__sum"))
    # sums never go back up over a closing event that had nothing open: what is below the lowest sum so far is depth 0
    low = F.min("__sum").over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    deep = summed.withColumn("__floor", F.least(F.lit(0), low)).withColumn("__before", F.least(F.lit(0), F.coalesce(F.lag("__floor").over(Window.partitionBy(key).orderBy("start")), F.lit(0))))
    used = deep.where(F.col("__opens") | (F.col("__floor") == F.col("__before")))
    level = F.col("__sum") - F.col("__floor") + F.when(F.col("__opens"), 0).otherwise(1)
    within = Window.partitionBy(key, "level").orderBy("start")
    paired = used.withColumn("level", level).withColumn("end", F.lead("start").over(within))
    return paired.where(F.col("__opens") & F.col("end").isNotNull()).select(key, "level", "start", "end")
