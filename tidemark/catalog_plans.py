"""Queries over the ledger: reads, repair and publish planning, counts. Tables stand in by role as in catalog.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import BYTES_LIMIT, CHECKS, DATE_LIMIT, EPOCH, EV, NOW, PIXELS, events, order_shots, query, shot_checks, table
from .functions import dates, geo
from .operators import asof, checks, ledger, publishing, reads, repair

#: Ledger tables by role, as SQL and as columns of the driver's tables.
JOBS = "j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'pending' END AS state, epoch_us(o_orderdate) // 1000000 AS started_at, o_orderpriority AS kind, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS summary FROM orders)"
TRACKS = "t AS (SELECT c_custkey AS id, c_name AS name, c_custkey * 37 % 1000 AS imported_at, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS gpx FROM customer)"
PUBLISHES = "p AS (SELECT o_orderkey AS shot_id, o_custkey % 50 AS session_id, CASE o_orderkey % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'uploaded' WHEN 2 THEN 'creating' WHEN 3 THEN 'failed' ELSE 'pending' END AS state, concat('IMG_', o_orderkey % 1000) AS stem, CASE WHEN o_orderkey % 5 = 3 THEN 'timeout' END AS error FROM orders)"
GONE = "g AS (SELECT s_suppkey AS id, s_suppkey * 13 % 40 AS deleted_at FROM supplier)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
    return o.select(F.col("o_orderkey").alias("id"), state.alias("state"), dates.seconds(F.col("o_orderdate")).alias("started_at"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("summary"))


def tracks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), (k * 37 % 1000).alias("imported_at"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("gpx"))


def publishes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*(F.lit(x) for x in ("created", "uploaded", "creating", "failed", "pending"))), (k % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("shot_id"), (F.col("o_custkey") % 50).alias("session_id"), state.alias("state"), F.concat(F.lit("IMG_"), k % 1000).alias("stem"), F.when(k % 5 == 3, "timeout").alias("error"))


def tombstones(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (k * 13 % 40).alias("deleted_at"))


#: Reads of one kind: name, rows, where, columns, order, SQL.
READS = [
    ("jobs_with_status", jobs, {"state": "running"}, ["id", "state", "started_at"], ["started_at", "id"], f"WITH {JOBS} SELECT id, state, started_at FROM j WHERE state = 'running'"),
    ("get_job", jobs, {"id": 7}, ["id", "state", "summary"], [], f"WITH {JOBS} SELECT id, state, summary FROM j WHERE id = 7"),
    ("tracks_by_age", tracks, {}, ["id", "name", "imported_at"], ["-imported_at", "id"], f"WITH {TRACKS} SELECT id, name, imported_at FROM t"),
    ("track_row", tracks, {"id": 12}, ["id", "name", "imported_at"], [], f"WITH {TRACKS} SELECT id, name, imported_at FROM t WHERE id = 12"),
    ("track_text", tracks, {"id": [12, 13]}, ["id", "gpx"], [], f"WITH {TRACKS} SELECT id, gpx FROM t WHERE id IN (12, 13)"),
    ("track_stamps", tracks, {}, ["id", "imported_at", "length(gpx) > 0 AS has_text"], [], f"WITH {TRACKS} SELECT id, imported_at, length(gpx) > 0 AS has_text FROM t"),
    ("tombstones", tombstones, {}, ["id", "deleted_at"], ["deleted_at", "id"], f"WITH {GONE} SELECT id, deleted_at FROM g"),
    ("publishes_for_session", publishes, {"session_id": 3}, ["shot_id", "stem", "state"], ["stem", "shot_id"], f"WITH {PUBLISHES} SELECT shot_id, stem, state FROM p WHERE session_id = 3"),
    ("publishes_matching", publishes, {"state": ["failed", "creating"], "session_id": (10, 20)}, ["shot_id", "state", "error"], ["shot_id"], f"WITH {PUBLISHES} SELECT shot_id, state, error FROM p WHERE state IN ('failed', 'creating') AND session_id BETWEEN 10 AND 20"),
    ("publish_row", publishes, {"shot_id": 5}, ["shot_id", "state", "error"], [], f"WITH {PUBLISHES} SELECT shot_id, state, error FROM p WHERE shot_id = 5"),
    ("publish_without_error", publishes, {"error": None}, ["shot_id"], [], f"WITH {PUBLISHES} SELECT shot_id FROM p WHERE error IS NULL"),
    ("device_fixes_between", lambda s, d: events(s, d), {"event_type": "click", "at": (EPOCH, EPOCH + 86_400)}, ["event_id"], ["at"], f"WITH {EV} SELECT event_id FROM ev WHERE event_type = 'click' AND t_at BETWEEN {EPOCH} AND {EPOCH + 86400}"),
]
for _name, _rows, _where, _columns, _order, _sql in READS:

    def _read(spark: SparkSession, d: str, rows=_rows, where=_where, columns=_columns, order=_order) -> DataFrame:
        return reads.read(rows(spark, d), where, order=order).selectExpr(*columns)

    _read.__name__, _read.__doc__ = _name, f"Ledger rows where {_where or 'any'}, in order."
    query(_sql)(_read)


#: Settings and sessions: one row per key, read by key.
@query("SELECT n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey = 7")
def get_setting(spark: SparkSession, d: str) -> DataFrame:
    return reads.read(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), {"key": 7})


SESSIONS = "s AS (SELECT c_custkey AS id, c_mktsegment AS state, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 END AS dry_run_at, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS report, c_custkey % 7 AS agreement, CASE WHEN c_custkey % 5 = 0 THEN 'file' ELSE 'source' END AS key_kind FROM customer)"


@query(f"WITH {SESSIONS} SELECT id, state, dry_run_at, report, agreement, key_kind FROM s WHERE id IN (4, 6, 9, 10)")
def session_facts(spark: SparkSession, d: str) -> DataFrame:
    """A session's state, its dry run, its report, its agreement, and what kind of key it publishes under."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k.alias("id"), F.col("c_mktsegment").alias("state"), F.when(k % 2 == 0, k * 10).alias("dry_run_at"), F.when(k % 3 == 0, F.col("c_name")).alias("report"), (k % 7).alias("agreement"), F.when(k % 5 == 0, "file").otherwise("source").alias("key_kind")
    )
    return reads.read(rows, {"id": [4, 6, 9, 10]})


@query("SELECT DISTINCT upper(concat('Img_', l_orderkey % 500)) AS stem FROM lineitem WHERE l_suppkey % 3 = 1")
def shot_stems(spark: SparkSession, d: str) -> DataFrame:
    """Distinct stems of one scope, in upper case."""
    rows = table(spark, d, "lineitem").where(F.col("l_suppkey") % 3 == 1)
    return rows.select(F.upper(F.concat(F.lit("Img_"), F.col("l_orderkey") % 500)).alias("stem")).distinct()


@query(f"WITH {EV} SELECT event_id, t_at AS at_s FROM ev WHERE t_at IN (SELECT t_at FROM ev WHERE event_type = 'signup')")
def points_at(spark: SparkSession, d: str) -> DataFrame:
    """Fixes at the instants of a table."""
    rows = events(spark, d)
    return reads.points_at(rows, rows.where("event_type = 'signup'").select("at")).select("event_id", F.col("at").alias("at_s"))


@query(f"WITH {EV} SELECT event_id FROM ev WHERE NOT (t_at BETWEEN {EPOCH} AND {EPOCH + 5 * 86400})")
def clear_device_fixes(spark: SparkSession, d: str) -> DataFrame:
    return reads.delete_range(events(spark, d), "at", EPOCH, EPOCH + 5 * 86_400).select("event_id")


@query("SELECT o_orderkey AS at_s, o_custkey AS track_id FROM orders WHERE o_custkey % 100 = 7 AND o_orderstatus = 'F'")
def conflicts_for_track(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("at_s"), F.col("o_custkey").alias("track_id"), "o_orderstatus", (F.col("o_custkey") % 100).alias("part"))
    return reads.read(rows, {"part": 7, "o_orderstatus": "F"}, ["at_s", "track_id"], ["at_s"])


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40 OFFSET 120")
def viewport_slice(spark: SparkSession, d: str) -> DataFrame:
    return reads.page(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), "c_custkey"], 120, 40).select("c_custkey")


@query("SELECT (SELECT count(*) FROM customer) AS cards, (SELECT count(*) FROM orders) AS shots, (SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0) AS without_candidate, 10 AS schema_version")
def ledger_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ledger tables, shots without a candidate, and the version of the tables' layout."""
    o = table(spark, d, "orders").agg(F.count("*").alias("shots"), F.count_if(F.col("o_orderkey") % 11 == 0).alias("without_candidate"))
    return table(spark, d, "customer").agg(F.count("*").alias("cards")).join(o, F.lit(True)).withColumn("schema_version", F.lit(10))


@query(f"WITH {JOBS} SELECT id, CASE WHEN state IN ('pending', 'running') THEN 'interrupted' ELSE state END AS state FROM j")
def recover_interrupted_jobs(spark: SparkSession, d: str) -> DataFrame:
    return publishing.recover_jobs(jobs(spark, d)).select("id", "state")


@query(f"""WITH {TRACKS}, {GONE}, d AS (SELECT id FROM t WHERE id % 7 = 0), p AS (SELECT o_custkey AS track_id FROM orders), tn AS (SELECT id, 5000 AS deleted_at FROM d UNION ALL SELECT id, deleted_at FROM g WHERE id NOT IN (SELECT id FROM d))
SELECT 'tracks' AS part, count(*) AS n, sum(id) AS total FROM t WHERE id % 7 <> 0 UNION ALL SELECT 'points', count(*), sum(track_id) FROM p WHERE track_id NOT IN (SELECT id FROM d) UNION ALL SELECT 'removed', count(*), sum(track_id) FROM p WHERE track_id IN (SELECT id FROM d)
UNION ALL SELECT 'tombstones', count(*), sum(deleted_at) FROM tn""")
def delete_track(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh track deleted with its points; what is left, what went, and the tombstones."""
    points = table(spark, d, "orders").select(F.col("o_custkey").alias("track_id"))
    mine = tracks(spark, d)
    left = ledger.delete_tracks(mine, points, points.limit(0), tombstones(spark, d), mine.where("id % 7 = 0").union(mine.where("id = 7").withColumn("id", F.lit(-1).cast("long"))), 5000)
    total = lambda rows, part, n, x: rows.agg(n.alias("n"), F.sum(x).alias("total")).select(F.lit(part).alias("part"), "n", "total")
    one = F.count("*")
    out = total(left["tracks"], "tracks", one, "id").union(total(left["points"], "points", one, "track_id")).union(total(left["tombstones"], "tombstones", one, "deleted_at"))
    return out.union(total(left["removed"], "removed", F.sum("n"), F.col("track_id") * F.col("n")))


# Repairs


@query(f"""{CHECKS}, a(failure, actions, default_action) AS (VALUES {", ".join(f"('{k}', '{','.join(v)}', " + (f"'{repair.DEFAULTS[k]}'" if k in repair.DEFAULTS else "NULL") + ")" for k, v in repair.ACTIONS.items())})
SELECT shot, rule, failure, actions, default_action FROM c JOIN a USING (failure) WHERE status = 'fail'""")
def repair_actions(spark: SparkSession, d: str) -> DataFrame:
    """What may be done about each failed check, and what is offered first."""
    failure = F.col("failure")
    failed = shot_checks(spark, d).where("status = 'fail'")
    return failed.select("shot", "rule", "failure", F.array_join(repair.actions_for(failure), ",").alias("actions"), repair.default_action(failure).alias("default_action"))


REPAIRS = [("no_date", "enter_date_manually", 1_700_000_000), ("no_date", "derive_from_batch_median", None), ("no_date", "use_file_modification_time", None), ("date_out_of_range_batch", "bulk_shift", None), ("date_out_of_range", "publish_anyway", None), ("too_many_pixels", "resize", None), ("too_large", "reencode_lower", None)]
_FIT = f"CASE WHEN width * height > {PIXELS} * 1e6 THEN greatest(1, CAST(floor({{}} * sqrt({PIXELS} * 1e6 / (CAST(width AS DOUBLE) * height))) AS INTEGER)) END"


@query(f"""{CHECKS}, f AS (SELECT DISTINCT c.failure, x.*, CASE WHEN shot % 13 = 0 THEN NULL WHEN shot % 17 = 0 THEN -5 ELSE shot * 1000 END AS modified FROM c JOIN x USING (shot) WHERE c.failure IS NOT NULL),
r AS (SELECT shot, 'enter_date_manually' AS action, CAST(1700000000 AS BIGINT) AS new_date, CAST(NULL AS INTEGER) AS target_width, CAST(NULL AS INTEGER) AS target_height, CAST(NULL AS VARCHAR) AS destination, CAST(NULL AS BIGINT) AS max_bytes, CAST(NULL AS VARCHAR) AS reason FROM f WHERE failure = 'no_date'
UNION ALL SELECT shot, 'derive_from_batch_median', median, NULL, NULL, NULL, NULL, CASE WHEN median IS NULL THEN 'no capture date on this card to derive one from' END FROM f WHERE failure = 'no_date'
UNION ALL SELECT shot, 'use_file_modification_time', modified, NULL, NULL, NULL, NULL, CASE WHEN modified IS NULL THEN 'modification time missing' WHEN modified < 0 THEN 'modified before the epoch' END FROM f WHERE failure = 'no_date'
UNION ALL SELECT shot, 'bulk_shift', capture + {NOW} - median, NULL, NULL, NULL, NULL, NULL FROM f WHERE failure = 'date_out_of_range_batch'
UNION ALL SELECT shot, 'publish_anyway', NULL, NULL, NULL, NULL, NULL, NULL FROM f WHERE failure = 'date_out_of_range'
UNION ALL SELECT shot, 'resize', NULL, {_FIT.format("width")}, {_FIT.format("height")}, concat('out/S', shot, '.jpg'), {BYTES_LIMIT}, NULL FROM f WHERE failure = 'too_many_pixels'
UNION ALL SELECT shot, 'reencode_lower', NULL, NULL, NULL, concat('out/S', shot, '.jpg'), {BYTES_LIMIT}, NULL FROM f WHERE failure = 'too_large') SELECT * FROM r""")
def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every bulk action's plan, what it leaves out with it."""
    k = F.col("shot")
    rows = order_shots(spark, d).withColumn("modified", F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, -5).otherwise(k * 1000).cast("long")).withColumn("stem", F.concat(F.lit("S"), k))
    found = shot_checks(spark, d)
    out = None
    for failure, action, date in REPAIRS:
        plan = repair.plan_bulk(rows, found, failure, action, card="card", ident="shot", now=NOW, max_age_days=DATE_LIMIT, max_bytes=BYTES_LIMIT, megapixels=PIXELS, output_dir="out", date=date)
        both = plan.actions.withColumn("reason", F.lit(None).cast("string")).unionByName(plan.skipped, allowMissingColumns=True)
        out = both if out is None else out.unionByName(both)
    return out


@query("""WITH f AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS capture, CASE o_orderkey % 4 WHEN 0 THEN make_timestamp(o_orderkey * 1000000) WHEN 1 THEN make_timestamp((o_orderkey + 7) * 1000000) END AS sidecar_date FROM orders),
r AS (SELECT path, 'manual' AS mode, TIMESTAMP '2020-05-06 07:08:09' AS new_date, CAST(NULL AS VARCHAR) AS shift, 'no date given' AS why FROM f UNION ALL SELECT path, 'auto', capture, NULL, 'the file holds no date' FROM f
UNION ALL SELECT path, 'shift', capture - INTERVAL 14 MONTH - INTERVAL 3 DAY - INTERVAL 14706 SECOND, '-1:2:3 4:5:6', 'the file holds no date that could move' FROM f UNION ALL SELECT path, 'sidecar', sidecar_date, NULL, 'no sidecar beside the file' FROM f)
SELECT path, mode, epoch_us(new_date) // 1000000 AS at_s, CASE WHEN new_date IS NOT NULL THEN shift END AS shift, CASE WHEN new_date IS NULL THEN why END AS reason FROM r""")
def date_repair_plan(spark: SparkSession, d: str) -> DataFrame:
    """New dates by hand, from the file, moved, and from JSON sidecars."""
    k = F.col("o_orderkey")
    stamp = lambda field, at: F.concat(F.lit(f'{{"{field}": {{"timestamp": "'), at.cast("string"), F.lit('"}}'))
    sidecar = F.when(k % 4 == 0, stamp("photoTakenTime", k)).when(k % 4 == 1, stamp("creationTime", k + 7)).when(k % 4 == 2, "not json")
    files = table(spark, d, "orders").select(k.alias("path"), F.when(k % 5 != 0, F.col("o_orderdate").cast("timestamp")).alias("capture"), F.timestamp_seconds(repair.sidecar_date(sidecar)).alias("sidecar_date"))
    out = None
    for mode, how in (("manual", {"date": F.lit("2020-05-06 07:08:09").cast("timestamp")}), ("auto", {}), ("shift", {"shift": "-1:2:3 4:5:6"}), ("sidecar", {})):
        plan = repair.plan_dates(files, mode, **how)
        both = plan.actions.withColumn("reason", F.lit(None).cast("string")).unionByName(plan.skipped).withColumn("mode", F.lit(mode))
        out = both if out is None else out.unionByName(both)
    return out.select("path", "mode", F.unix_seconds("new_date").alias("at_s"), F.when(F.col("new_date").isNotNull(), F.col("shift")).alias("shift"), "reason")


@query("""WITH f AS (SELECT concat('img', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.txt' ELSE '.jpg' END) AS name, p_size AS ev, concat('OUT', p_partkey // 2, '.jpg') AS output FROM part),
e AS (SELECT lower(concat('out', p_partkey * 5, '.JPG')) AS output FROM part), q AS (SELECT name, output, CASE WHEN ev > 40 THEN 'exposure out of range' WHEN name LIKE '%.txt' THEN 'not a file that this tool reads' WHEN lower(output) IN (SELECT output FROM e) THEN 'the output exists already' END AS early FROM f)
SELECT name, output, coalesce(early, CASE WHEN name > min(name) FILTER (WHERE early IS NULL) OVER (PARTITION BY lower(output)) THEN 'another file has this output' END) AS reason FROM q""")
def develop_plan(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of a batch: rules first, then extensions, outputs that exist, and the first to claim one."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    files = p.select(F.concat(F.lit("img"), k, F.when(k % 4 == 0, ".txt").otherwise(".jpg")).alias("name"), F.col("p_size").alias("ev"), F.floor(k / 2).alias("half"))
    existing = p.select(F.concat(F.lit("out"), k * 5, F.lit(".JPG")).alias("output"))
    plan = repair.plan_outputs(files, F.concat(F.lit("OUT"), F.col("half"), F.lit(".jpg")), ["jpg"], existing, (F.col("ev") > 40, "exposure out of range"))
    rows = plan.actions.withColumn("reason", F.lit(None).cast("string")).unionByName(plan.skipped)
    return rows.select("name", "output", "reason")


@query("""WITH w AS (SELECT p_partkey AS id, concat('A', p_partkey % 100, '.jpg') AS target, row_number() OVER (PARTITION BY p_partkey % 100 ORDER BY p_partkey) - 1 AS r FROM part)
SELECT id, concat('A', id % 100, CASE WHEN f > 0 THEN concat('_', f) ELSE '' END, '.jpg') AS free_name FROM (SELECT *, CASE WHEN id % 100 % 2 = 1 THEN r WHEN r = 0 THEN 1 ELSE r + 2 END AS f FROM w)""")
def collision_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that nothing has: of even series the plain name and number 2 are there already."""
    k = F.col("p_partkey")
    wanted = table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("A"), k % 100, F.lit(".jpg")).alias("target"))
    there = spark.range(0, 100, 2).select(F.explode(F.array(F.concat(F.lit("a"), "id", F.lit(".JPG")), F.concat(F.lit("a"), "id", F.lit("_2.jpg")))).alias("name"))
    return repair.free_names(wanted, there, "target", ["id"]).select("id", "free_name")


# Publishing

SESSION = """pl AS (SELECT o_orderkey AS k, concat('F', o_orderkey, '.jpg') AS file_name, concat('S', o_orderkey) AS stem, CASE o_orderkey % 4 WHEN 0 THEN 'already_published' WHEN 1 THEN 'already_staged' ELSE 'send' END AS disposition FROM orders),
ma AS (SELECT file_name, sha256(file_name) AS source_sha256, k * 10 AS bytes, stem FROM pl WHERE k % 7 <> 0), re AS (SELECT file_name, CASE k % 9 WHEN 0 THEN 'missing' WHEN 1 THEN 'hash_mismatch' ELSE 'verified' END AS outcome FROM pl WHERE k % 10 <> 0),
it AS (SELECT concat('sess:', source_sha256) AS shot_id, pl.stem, pl.file_name, bytes, k, CASE WHEN disposition = 'already_published' THEN 'already published' WHEN ma.file_name IS NULL THEN 'not in the session''s manifest' WHEN outcome IS NULL THEN 'the staged file is not verified' WHEN outcome <> 'verified' THEN concat('the staged file is ', outcome) END AS reason FROM pl LEFT JOIN ma USING (file_name) LEFT JOIN re USING (file_name))"""


def session_plan(spark: SparkSession, d: str):
    k = F.col("k")
    planned = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.lit("sess").alias("session_id"), F.concat(F.lit("F"), k, F.lit(".jpg")).alias("file_name"), F.concat(F.lit("S"), k).alias("stem"), F.when(k % 4 == 0, "already_published").when(k % 4 == 1, "already_staged").otherwise("send").alias("disposition"))
    manifest = planned.where("k % 7 <> 0").select("file_name", "stem", F.sha2("file_name", 256).alias("source_sha256"), (k * 10).alias("bytes"))
    report = planned.where("k % 10 <> 0").select("file_name", F.when(k % 9 == 0, "missing").when(k % 9 == 1, "hash_mismatch").otherwise("verified").alias("outcome"))
    return publishing.publishable(planned.drop("k"), manifest, report)


@query(f"WITH {SESSION} SELECT stem, CASE WHEN reason IS NULL THEN shot_id END AS shot_id, CASE WHEN reason IS NULL THEN bytes END AS bytes, reason FROM it")
def publishable(spark: SparkSession, d: str) -> DataFrame:
    """A session's items, and why the others stay."""
    plan = session_plan(spark, d)
    return plan.actions.select("stem", "shot_id", "bytes", F.lit(None).cast("string").alias("reason")).unionByName(plan.skipped, allowMissingColumns=True)


@query(f"""WITH {SESSION}, i AS (SELECT * FROM it WHERE reason IS NULL), l AS (SELECT shot_id, CASE k % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'creating' WHEN 2 THEN 'uploaded' ELSE 'failed' END AS state FROM i WHERE k % 2 = 0), o AS (SELECT count(*) AS n FROM i WHERE shot_id NOT IN (SELECT shot_id FROM l WHERE state = 'created'))
SELECT (SELECT sum(bytes) FROM i) AS total_bytes, n AS uploads, CAST(ceil(n / 50) AS BIGINT) AS batches, (SELECT count(*) FROM l WHERE state = 'uploaded') AS uploaded, (SELECT count(*) FROM l WHERE state = 'created') AS created, (SELECT count(*) FROM l WHERE state = 'creating') AS unconfirmed, (SELECT count(*) FROM l WHERE state = 'failed') AS pending FROM o""")
def publish_totals(spark: SparkSession, d: str) -> DataFrame:
    """Bytes and requests that a publish needs, and where an earlier one got to."""
    items = session_plan(spark, d).actions
    k = F.substring("stem", 2, 20).cast("long")
    state = F.when(k % 5 == 0, "created").when(k % 5 == 1, "creating").when(k % 5 == 2, "uploaded").otherwise("failed")
    return publishing.publish_totals(items, items.where(k % 2 == 0).select("shot_id", state.alias("state")))


@query(f"WITH {SESSION}, s AS (SELECT stem, reason FROM it WHERE reason IS NOT NULL ORDER BY stem, reason LIMIT 3) SELECT concat(string_agg(concat(stem, ' (', reason, ')'), ', ' ORDER BY stem, reason), ', and ', (SELECT count(*) - 3 FROM it WHERE reason IS NOT NULL), ' more') AS text FROM s")
def name_a_few(spark: SparkSession, d: str) -> DataFrame:
    return publishing.name_a_few(session_plan(spark, d).skipped)


@query("SELECT p_partkey AS k FROM part WHERE p_partkey % 4 <> 1 AND NOT (p_partkey % 4 = 3 AND p_partkey % 5 <> 0)")
def manifest_faults(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows with a file name that is no plain name, or without a session."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("a"), k, F.lit(".jpg"))).when(k % 4 == 2, "../x.jpg").otherwise("..x")
    rows = table(spark, d, "part").select(k.alias("k"), name.alias("file_name"), F.when((k % 4 == 3) & (k % 5 == 0), " ").otherwise("s").alias("session_id"))
    return publishing.bad_entries(rows).select("k")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS sha, n_chars AS bytes FROM documents), p AS (SELECT DISTINCT sha FROM h WHERE doc_id % 5 = 0), s AS (SELECT sha, max(bytes + doc_id % 2) AS size FROM h WHERE doc_id % 3 = 0 GROUP BY sha),
q AS (SELECT bytes, CASE WHEN p.sha IS NOT NULL THEN 'already_published' WHEN s.size = h.bytes THEN 'already_staged' ELSE 'send' END AS disposition FROM h LEFT JOIN p USING (sha) LEFT JOIN s USING (sha)) SELECT disposition, count(*) AS n, sum(bytes) AS bytes FROM q GROUP BY disposition""")
def disposition_totals(spark: SparkSession, d: str) -> DataFrame:
    """Entries and bytes by disposition: what is to be sent, and the manifest's total."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("bytes"))
    staged = rows.where("doc_id % 3 = 0").withColumn("bytes", F.col("bytes") + F.col("doc_id") % 2)
    return checks.disposition(rows, rows.where("doc_id % 5 = 0"), staged, "sha").groupBy("disposition").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(f"{CHECKS} SELECT DISTINCT failure, shot FROM c WHERE failure IS NOT NULL")
def failure_members(spark: SparkSession, d: str) -> DataFrame:
    """The shots of every failure."""
    return checks.with_failure(shot_checks(spark, d), "shot")


@query(f"""{CHECKS}, w AS (SELECT what, n FROM (SELECT count(DISTINCT shot) FILTER (WHERE failure = 'no_date') AS no_date, count(DISTINCT shot) FILTER (WHERE failure IN ('date_out_of_range', 'date_out_of_range_batch')) AS date_outside, count(DISTINCT shot) FILTER (WHERE rule = 'location' AND status = 'warn') AS no_location,
count(DISTINCT shot) FILTER (WHERE failure = 'too_many_pixels') AS too_many_pixels, count(DISTINCT shot) FILTER (WHERE failure = 'too_large') AS too_large FROM c) UNPIVOT (n FOR what IN (no_date, date_outside, no_location, too_many_pixels, too_large))) SELECT what, n FROM w WHERE n > 0""")
def work_needed(spark: SparkSession, d: str) -> DataFrame:
    """How many shots need which work; kinds of work that none needs are left out."""
    found = shot_checks(spark, d).groupBy("shot").agg(F.collect_set("failure").alias("f"), F.max(F.coalesce((F.col("rule") == "location") & (F.col("status") == "warn"), F.lit(False))).alias("nowhere"))
    has = lambda *names: F.count_if(F.arrays_overlap("f", F.array(*(F.lit(x) for x in names))))
    counts = {"no_date": has("no_date"), "date_outside": has("date_out_of_range", "date_out_of_range_batch"), "no_location": F.count_if("nowhere"), "too_many_pixels": has("too_many_pixels"), "too_large": has("too_large")}
    row = found.agg(*(v.alias(k) for k, v in counts.items()))
    lines = F.array(*(F.struct(F.lit(k).alias("what"), F.col(k).alias("n")) for k in counts))
    return row.select(F.inline(lines)).where("n > 0")


@query("SELECT l_shipmode_ AS rung, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY rung")
def by_rung(spark: SparkSession, d: str) -> DataFrame:
    """Derived files by the step that made them, and their bulk total."""
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("rung")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("total"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'not_supported' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'ok' WHEN o_orderkey % 2 = 0 THEN 'no_location' WHEN o_orderkey % 3 = 0 THEN 'no_date' ELSE 'no_date_or_location' END AS status FROM orders")
def geo_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", geo.geo_status(k % 2 == 0, k % 3 == 0, k % 10 == 0).alias("status"))


@query("""WITH i AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000000 AS a, epoch_us(o_orderdate) // 1000000 + (o_orderkey % 400 - 5) * 86400 AS b, CAST(o_orderkey % 100 AS DOUBLE) AS lat FROM orders), g AS (SELECT * FROM i WHERE lat <= 90),
n AS (SELECT *, lead(a) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey) AS nxt FROM g), k AS (SELECT * FROM n WHERE NOT (b < a OR coalesce(nxt < b, false))) SELECT o_orderkey, a AS at_s FROM k UNION SELECT o_orderkey, b FROM k""")
def placed_points(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of stops that can be written; one point where they are one instant."""
    start = dates.seconds(F.col("o_orderdate"))
    k = F.col("o_orderkey")
    stops = table(spark, d, "orders").select("o_custkey", "o_orderkey", start.alias("a"), (start + (k % 400 - 5) * 86_400).alias("b"), (k % 100).cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    return asof.placed_points(stops, ["o_custkey"], "a", "b", "o_orderkey")[0].select("o_orderkey", F.col("at").alias("at_s"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey WHEN p_partkey % 3 = 1 AND p_partkey % 5 <> 0 THEN p_partkey END AS found FROM part")
def table_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Colour tables found by their hash, else by their name whatever its case."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    library = p.select(k.alias("id"), F.concat(F.lit("Look "), k).alias("name"), F.sha2(k.cast("string"), 256).alias("sha256"))
    wanted = p.select("p_partkey", F.when((k % 3 == 1) & (k % 5 != 0), F.concat(F.lit("LOOK "), k)).otherwise("none").alias("name"), F.when(k % 3 == 0, F.sha2(k.cast("string"), 256)).otherwise("-").alias("sha256"))
    return reads.by_either_key(wanted, library).select("p_partkey", "found")
