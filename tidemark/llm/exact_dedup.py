"""Exact deduplication over an extendible-hash index on shared files.

Every text gets a 64-bit key and a SHA-256. Distinct keys with their row counts
are the index entries. A directory over the keys' leading bits doubles where a bucket
holds more than `capacity` entries, and as long as one does, so that no bucket is
over capacity in the end. Buckets are contiguous key ranges; the directory is a
table, never a list in the driver.

Only texts whose key several rows have go on. The directory names the bucket of
each; copies are combined in each task before they are shuffled, so a hot text
comes once from a task. Owner tasks take ranges of buckets: texts under one key
are compared by their bytes there and chained, each different one a link. The
chains are written to the shared folder in order of bucket and key, and rows find
their link by key and SHA-256, in a join of tables without texts that adaptive
execution can split for a hot key.

All of it is DataFrame work inside the JVM; a few counts reach the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, sized, stage, table, text_of

BITS = 64


def _leading(key: Column, bits: int) -> Column:
    """The key's leading bits as a number."""
    return F.shiftrightunsigned(key, BITS - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int) -> DataFrame:
    """entries (key, n; keys are distinct) with bucket: the first key of the bucket's range.

    It starts with about half as many buckets as would be full. A bucket that is
    over capacity is split by its next bit, and the round is repeated for the
    entries of those alone; a whole key always fits, so it ends.
    """
    capacity = max(1, capacity)
    depth = max(0, math.ceil(math.log2(max(1, entries.count()) / capacity)) - 1)
    waiting, placed = entries, []
    while True:
        prefix = _leading(F.col("key"), depth)
        buckets = stage(waiting.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("held")), "dedup-buckets")
        found = waiting.withColumn("prefix", prefix).join(sized(buckets), "prefix")
        first = F.shiftleft("prefix", BITS - depth) if depth else F.lit(0).cast("long")
        placed.append(found.where(F.col("held") <= capacity).select("key", "n", first.alias("bucket")))
        if not buckets.where(F.col("held") > capacity).limit(1).count():
            return reduce(DataFrame.unionByName, placed)
        waiting = stage(found.where(F.col("held") > capacity).select("key", "n"), "dedup-overfull")
        depth += 1


def build(docs: DataFrame, keys: DataFrame, capacity: int) -> DataFrame:
    """The index: chains (bucket, key, link, sha, keep_id, group_size) of the keys that several rows have.

    docs: id, text; keys: key of every row.
    """
    entries = stage(keys.groupBy("key").agg(F.count("*").alias("n")), "dedup-entries")
    routes = stage(directory(entries, capacity).where("n > 1").select("key", "bucket"), "dedup-routes")
    texts = docs.withColumn("key", F.xxhash64("text")).join(sized(routes), "key")
    groups = texts.groupBy("bucket", "key", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = groups.repartitionByRange("bucket", "key")
    link = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text")) - 1
    chains = owned.select("bucket", "key", link.alias("link"), F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    return stage(chains.sortWithinPartitions("bucket", "key", "link"), "dedup-index")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 16) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; its largest id stays. A null text counts as empty.
    Null ids rank below all others; a group of null ids only has a null keep_id.
    Rows that repeat an id and its text count in group_size each, and are all
    marked kept if that id is. Other columns of docs are ignored, whatever
    their names; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    keys = stage(rows.select("id", F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("sha")), "dedup-keys")
    chains = build(rows, keys, capacity).select("key", "sha", "keep_id", "group_size")
    out = keys.join(chains, ["key", "sha"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))).select(id_col, "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup does not keep; rows that repeat an id and its text become one."""
    marks = exact_dedup(docs, id_col=id_col, text_col=text_col)
    gone = stage(marks.where("group_size > 1").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"), "kept").distinct(), "dedup-gone")
    rows = docs.select(F.col(id_col).alias("__own_id"), F.sha2(text_of(text_col), 256).alias("__own_sha"), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)))
    rows = rows.join(sized(gone), F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_sha") == F.col("__sha")), "left")
    single = rows.where("kept is null")
    again = rows.where("kept").dropDuplicates(["__own_id", "__own_sha"])
    return single.unionByName(again).select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup of all documents with production parameters."""
    return exact_dedup(table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
