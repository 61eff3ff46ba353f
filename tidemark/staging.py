"""Tables staged in the cluster's shared folder, and positions in a total order."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only for a local master that has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/{os.getpid()}"


def kept_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for what other writers put there; clean() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED[path] = spark
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once to the shared folder (with the writer's options) and read it from there: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _STAGED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # noqa: SLF001
    return out


def stage_stream(df: DataFrame, name: str) -> DataFrame:
    """The same for a stream: all there is now is written, with its checkpoint beside it, and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED[path] = spark
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    out = spark.read.schema(df.schema).parquet(f"{path}/rows")
    out._staged_path = path  # noqa: SLF001
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing lazy reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path and (spark := _STAGED.pop(path, None)):
            delete(spark, path)


@atexit.register
def clean() -> None:
    """Delete whatever is still staged; call it before a session is stopped, for afterwards nothing can be reached."""
    while _STAGED:
        path, spark = _STAGED.popitem()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001, S112  the context may be gone by now
            continue


def sized(rows: DataFrame, most_rows: int = 1 << 18) -> DataFrame:
    """A staged side of a join: broadcast up to most_rows (counted), else joined by a shuffled hash join."""
    return F.broadcast(rows) if rows.count() <= most_rows else rows.hint("shuffle_hash")


def with_place(df: DataFrame, order: Sequence, column: str = "place") -> tuple[DataFrame, int]:
    """df with its 0-based place in a total order, and the number of rows.

    Rows are range-partitioned and sorted within partitions; no task sees more
    than its range. The sorted rows are staged, so that places do not move when
    a task runs again; one count per partition comes to the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = stage(ranged.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    total, firsts = 0, []
    for p in range(max(counts, default=-1) + 1):
        firsts.append(total)
        total += counts.get(p, 0)
    before = F.element_at(F.array(*(F.lit(x).cast("long") for x in firsts or [0])), part.cast("int") + 1)
    return rows.withColumn(column, before + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at"), total
