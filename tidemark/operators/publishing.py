"""What a publish would send: items, reasons for what stays behind, and the number of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.plan import Plan, first_reason

BATCH = 50


def publishable(planned: DataFrame, manifest: DataFrame, report: DataFrame | None) -> Plan:
    """Items (shot_id, stem, source_sha256, file_name, bytes) of a session, and the rest with reasons.

    planned: session_id, file_name, stem, disposition; manifest: file_name, stem,
    source_sha256, bytes; report: file_name, outcome as checks.verify_arrivals
    gives it, or None before anything has been verified.
    """
    m = manifest.select(F.col("file_name").alias("_file"), F.col("stem").alias("_stem"), "source_sha256", "bytes")
    rows = planned.join(m, F.col("file_name") == F.col("_file"), "left")
    arrived = report.select(F.col("file_name").alias("_arrived"), "outcome") if report is not None else None
    rows = rows.join(arrived, F.col("file_name") == F.col("_arrived"), "left") if report is not None else rows.withColumn("outcome", F.lit(None).cast("string"))
    why = F.coalesce("outcome", F.lit("not verified"))
    reason = first_reason((F.col("disposition") == "already_published", "already published"), (F.col("_file").isNull(), "not in the session's manifest"), (F.lit(report is None), "the staged files have not been verified yet"))
    reason = F.coalesce(reason, F.when(F.coalesce(F.col("outcome") != "verified", F.lit(True)), F.concat(F.lit("the staged file is "), why)))
    out = rows.select(F.concat_ws(":", "session_id", "source_sha256").alias("shot_id"), F.coalesce("_stem", "stem").alias("stem"), "source_sha256", "file_name", "bytes", reason.alias("_reason"))
    return Plan(out.where("_reason is null").drop("_reason"), out.where("_reason is not null").select("stem", F.col("_reason").alias("reason")))


def publish_totals(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: total_bytes, uploads, batches, and how many of the ledger's rows (shot_id, state) are uploaded, created, unconfirmed, pending."""
    created = ledger.where("state = 'created'").select("shot_id")
    left = items.join(created, "shot_id", "left_anti").agg(F.count("*").alias("uploads"), F.ceil(F.count("*") / BATCH).alias("batches"))
    size = items.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    known = {"uploaded": "uploaded", "created": "created", "creating": "unconfirmed"}
    counts = ledger.agg(*(F.count_if(F.col("state") == s).alias(n) for s, n in known.items()), F.count_if(F.coalesce(~F.col("state").isin(list(known)), F.lit(True))).alias("pending"))
    return size.join(left, F.lit(True)).join(counts, F.lit(True))


def name_a_few(skipped: DataFrame, shown: int = 3) -> DataFrame:
    """One row, text: the first few skipped stems with their reasons, and how many more there are."""
    first = skipped.orderBy("stem", "reason").limit(shown)
    named = first.agg(F.array_sort(F.collect_list(F.struct("stem", "reason"))).alias("few"))
    line = F.array_join(F.transform("few", lambda x: F.concat(x["stem"], F.lit(" ("), x["reason"], F.lit(")"))), ", ")
    total = skipped.agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > shown, F.concat(line, F.format_string(", and %d more", F.col("n") - shown))).otherwise(line)
    return named.join(total, F.lit(True)).select(more.alias("text"))


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """jobs after a restart: what was waiting or running is interrupted."""
    return jobs.withColumn("state", F.when(F.col("state").isin("pending", "running"), "interrupted").otherwise(F.col("state")))


def bad_entries(manifest: DataFrame) -> DataFrame:
    """Rows of a manifest that no session may be opened with: a blank session, or a file name that is no plain name."""
    name = F.col("file_name")
    good = (F.trim("session_id") != "") & (name != "") & ~name.contains("/") & ~name.isin(".", "..")
    return manifest.where(~F.coalesce(good, F.lit(False)))
