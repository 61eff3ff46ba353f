"""Registered queries over the driver's tables and the SQL that each equals.

The tables hold no photographs, so they stand in by role: events are fixes and
captures, lineitem files of a shot, customers and suppliers replicas and cards,
documents file contents, conversations event logs, embeddings raster rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import colour, dates, geo, text
from .operators import arrays, asof, checks, ledger, raster, shots, stats, timeline
from .operators.sequence import with_neighbour
from .plans.plan import Plan, first_reason
from .session import ship
from .sources import tables
from .staging import stage_stream
from .streaming import rollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EPOCH = 1_704_067_200  # 2024-01-01
#: Common parts of the SQL side.
EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS t_at FROM events)"
POS = "pos AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS t_at, (user_id * 7919 % 17000) / 100.0 - 85 AS lat, (event_id * 104729 % 35000) / 100.0 - 175 AS lon, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 500 / 1.0 END AS ele FROM events)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", dates.seconds(F.col("ts")).alias("at"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    lat = (F.col("user_id") * 7919 % 17000) / 100.0 - 85
    lon = (F.col("event_id") * 104729 % 35000) / 100.0 - 175
    ele = F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 500).cast("double"))
    return rows.select("event_id", "user_id", "event_type", "at", lat.alias("lat"), lon.alias("lon"), ele.alias("ele"))


def probes_and_fixes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, d)
    return rows.where("event_type = 'purchase'").select("event_id", "user_id", "at"), rows.where("event_type = 'error'").select("user_id", "at", F.col("event_id").alias("fix_id"))


PROBES = f"""WITH {EV}, p AS (SELECT event_id, user_id, t_at FROM ev WHERE event_type = 'purchase'), f AS (SELECT user_id, t_at FROM ev WHERE event_type = 'error'),
m AS (SELECT p.*, (SELECT max(f.t_at) FROM f WHERE f.user_id = p.user_id AND f.t_at <= p.t_at) AS prev_at, (SELECT min(f.t_at) FROM f WHERE f.user_id = p.user_id AND f.t_at >= p.t_at) AS next_at FROM p)"""


def _matched(spark: SparkSession, d: str, **how) -> DataFrame:
    probes, fixes = probes_and_fixes(spark, d)
    got = asof.match(probes, fixes, ["user_id"], order=["fix_id"], **how)
    return got.select("event_id", "user_id", F.col("fix.at").alias("fix_at"), "method", "gap")


@query(f"""{PROBES} SELECT event_id, user_id, coalesce(prev_at, next_at) AS fix_at,
CASE WHEN prev_at = t_at THEN 'exact' WHEN prev_at IS NOT NULL THEN 'carried_forward' WHEN next_at IS NOT NULL THEN 'nearest' ELSE 'none' END AS method,
CASE WHEN prev_at IS NOT NULL THEN t_at - prev_at ELSE next_at - t_at END AS gap FROM m""")
def asof_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the same user's last error at or before it, else the first after it."""
    return _matched(spark, d)


NEAREST = "CASE WHEN prev_at IS NOT NULL AND (next_at IS NULL OR t_at - prev_at <= next_at - t_at) THEN prev_at ELSE next_at END"


@query(f"""{PROBES} SELECT event_id, user_id, {NEAREST} AS fix_at, CASE WHEN prev_at = t_at THEN 'exact' WHEN coalesce(prev_at, next_at) IS NULL THEN 'none' ELSE 'nearest' END AS method,
abs(t_at - {NEAREST}) AS gap FROM m""")
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The closer error on either side; the earlier of two as close."""
    return _matched(spark, d, method="nearest")


@query(f"""{PROBES} SELECT event_id, user_id, CASE WHEN abs(t_at - {NEAREST}) <= 7200 THEN {NEAREST} END AS fix_at,
CASE WHEN coalesce(prev_at, next_at) IS NULL OR abs(t_at - {NEAREST}) > 7200 THEN 'none' WHEN prev_at = t_at THEN 'exact' ELSE 'nearest' END AS method, abs(t_at - {NEAREST}) AS gap FROM m""")
def asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """The nearest error within two hours; the limit itself counts."""
    return _matched(spark, d, method="nearest", tolerance=7200)


@query(f"""{PROBES}, r AS (SELECT CASE WHEN coalesce(prev_at, next_at) IS NULL THEN 'no fix' WHEN abs(t_at - {NEAREST}) > 7200 THEN 'too far' END AS reason FROM m) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def skip_groups(spark: SparkSession, d: str) -> DataFrame:
    """Probes that a plan leaves out, by reason."""
    probes, fixes = probes_and_fixes(spark, d)
    got = asof.match(probes, fixes, ["user_id"], method="nearest", tolerance=7200, order=["fix_id"])
    plan = Plan.of(got.drop("reason"), first_reason((F.col("gap").isNull(), "no fix"), (F.col("fix").isNull(), "too far")))
    return checks.skip_groups(plan.skipped)


@query(f"""WITH {EV}, inside AS (SELECT event_id, t_at AS at_s FROM ev WHERE t_at BETWEEN {EPOCH + 864000} - 3600 AND {EPOCH + 950400} + 3600)
SELECT * FROM inside UNION ALL (SELECT event_id, t_at FROM ev WHERE t_at < {EPOCH + 864000} - 3600 ORDER BY t_at DESC, event_id DESC LIMIT 1)
UNION ALL (SELECT event_id, t_at FROM ev WHERE t_at > {EPOCH + 950400} + 3600 ORDER BY t_at, event_id LIMIT 1)""")
def asof_bracket_window(spark: SparkSession, d: str) -> DataFrame:
    """A day with an hour's margin and one row on either side."""
    rows = events(spark, d).select("at", "event_id")
    return asof.bracket_window(rows, EPOCH + 864_000, EPOCH + 950_400, margin=3600).select("event_id", F.col("at").alias("at_s"))


OFFSETS = ", ".join(f"({o})" for o in asof.UTC_OFFSETS)


#: Gaps of each user's purchases to the nearest error under each offset, in order.
SCORES = f"""WITH {EV}, o(off) AS (VALUES {OFFSETS}), p AS (SELECT user_id, off, t_at - off * 60 AS t_at FROM ev, o WHERE event_type = 'purchase'), f AS (SELECT DISTINCT user_id, t_at FROM ev WHERE event_type = 'error'),
a AS (SELECT p.*, f.t_at AS before FROM p ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.t_at >= f.t_at), b AS (SELECT a.*, f.t_at AS after FROM a ASOF LEFT JOIN f ON a.user_id = f.user_id AND a.t_at <= f.t_at),
g AS (SELECT user_id, off, least(t_at - before, after - t_at) AS gap FROM b), l AS (SELECT user_id, off, list_sort(list(gap)) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY user_id, off)"""


@query(f"{SCORES} SELECT user_id, off AS offset_minutes, len(gaps) AS n, gaps[len(gaps) // 2 + 1] AS median_gap FROM l")
def offset_scores(spark: SparkSession, d: str) -> DataFrame:
    """Median gap to the nearest error of every user's purchases under each clock offset."""
    return asof.score_offsets(*probes_and_fixes(spark, d), ["user_id"])


@query(f"""{SCORES}, s AS (SELECT user_id, off, gaps[len(gaps) // 2 + 1] AS mg FROM l WHERE len(gaps) >= 3), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mg, abs(off), off) AS k FROM s),
w AS (SELECT user_id, t_at - lag(t_at) OVER (PARTITION BY user_id ORDER BY t_at) AS gap FROM ev WHERE event_type = 'error'), r AS (SELECT user_id, list_sort(list(gap)) AS v FROM w WHERE gap IS NOT NULL GROUP BY user_id), t AS (SELECT user_id, greatest(60, v[len(v) // 2 + 1]) AS step FROM r)
SELECT k.user_id, k.off AS offset_minutes, k.mg AS median_gap, string_agg(CAST(s.off AS VARCHAR), ',' ORDER BY s.off) AS plausible, count(*) = 1 AND k.mg <= 1800 AS confident FROM k JOIN s USING (user_id) LEFT JOIN t USING (user_id) WHERE k.k = 1 AND s.mg <= k.mg + coalesce(step, 60) GROUP BY k.user_id, k.off, k.mg""")
def offset_estimate(spark: SparkSession, d: str) -> DataFrame:
    """The offset that fits each user best, and whether it stands alone."""
    probes, fixes = probes_and_fixes(spark, d)
    got = asof.estimate_offset(probes.drop("event_id"), fixes, ["user_id"])
    return got.withColumn("plausible", F.array_join("plausible", ","))


@query("SELECT e.event_id, e.user_id, c.c_name AS source FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.value BETWEEN 10 AND 60")
def points_with_source(spark: SparkSession, d: str) -> DataFrame:
    """Fixes in a range with the name of the track that they came from."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("source"))
    return events(spark, d).where(F.col("value").between(10, 60)).join(names, "user_id").select("event_id", "user_id", "source")


@query(f"WITH {EV} SELECT event_id, t_at AS at_s FROM ev WHERE t_at BETWEEN {EPOCH + 86400} AND {EPOCH + 2 * 86400}")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where(F.col("at").between(EPOCH + 86_400, EPOCH + 2 * 86_400)).select("event_id", F.col("at").alias("at_s"))


@query(f"WITH {EV} SELECT event_type, min(t_at) AS first_at, max(t_at) AS last_at FROM ev GROUP BY event_type")
def extent(spark: SparkSession, d: str) -> DataFrame:
    return stats.extent(events(spark, d), "at", ["event_type"])


@query(f"WITH {POS} SELECT event_type, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM pos GROUP BY event_type")
def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return stats.bounds(positions(spark, d), ["event_type"])


@query(f"WITH {EV} SELECT CAST(floor((t_at - 19800) / 86400.0) AS BIGINT) AS day, count(*) AS n FROM ev GROUP BY 1")
def day_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Fixes by local day, five and a half hours behind UTC."""
    return stats.day_coverage(events(spark, d), "at", -19_800)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, event_type, n FROM r WHERE k = 1""")
def mode_device(spark: SparkSession, d: str) -> DataFrame:
    return stats.mode_of(events(spark, d), ["user_id"], "event_type")


@query(f"WITH {EV}, l AS (SELECT user_id, list_sort(list(value)) AS v FROM ev GROUP BY user_id) SELECT user_id, len(v) AS n, v[len(v) // 2 + 1] AS value FROM l")
def upper_median_by_key(spark: SparkSession, d: str) -> DataFrame:
    return stats.upper_median(events(spark, d), ["user_id"], "value")


@query(f"WITH {EV}, l AS (SELECT event_type, list_sort(list(value)) AS v FROM ev GROUP BY event_type) SELECT event_type, len(v) AS n, v[CAST(greatest(1, ceil(len(v) * 0.9)) AS BIGINT)] AS value FROM l")
def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return stats.nearest_rank(events(spark, d), ["event_type"], "value", 0.9)


@query(f"""WITH {EV}, g AS (SELECT user_id, t_at - lag(t_at) OVER (PARTITION BY user_id ORDER BY t_at) AS gap FROM ev), l AS (SELECT user_id, list_sort(list(gap)) AS v FROM g WHERE gap IS NOT NULL GROUP BY user_id)
SELECT user_id, len(v) AS n, greatest(60, v[len(v) // 2 + 1]) AS gap FROM l""")
def track_resolution(spark: SparkSession, d: str) -> DataFrame:
    return stats.resolution_seconds(events(spark, d), ["user_id"], "at")


ASSET = """a AS (SELECT CAST(l_orderkey AS VARCHAR) AS stem, CASE l_returnflag WHEN 'A' THEN 'jpeg' WHEN 'N' THEN 'raw' ELSE 'video' END AS kind,
CAST(l_quantity * 1000 AS BIGINT) AS bytes, concat(l_partkey, '/', l_suppkey, '/', l_linenumber) AS rel_path, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rank FROM lineitem)"""


def assets(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "jpeg").when(F.col("l_returnflag") == "N", "raw").otherwise("video")
    path = F.concat_ws("/", F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("stem"), kind.alias("kind"), (F.col("l_quantity") * 1000).cast("long").alias("bytes"), path.alias("rel_path"))


@query(f"WITH {ASSET}, r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY rank, bytes DESC, rel_path) AS k FROM a) SELECT stem, kind, bytes, rel_path FROM r WHERE k = 1")
def shot_candidate(spark: SparkSession, d: str) -> DataFrame:
    return shots.best_asset(assets(spark, d), ["stem"])


@query(f"WITH {ASSET} SELECT stem, count(*) AS n_assets, min(rank) = 1 AS needs_derivation, string_agg(rel_path, ',' ORDER BY rank, bytes DESC, rel_path) AS paths FROM a GROUP BY stem")
def shot_groups(spark: SparkSession, d: str) -> DataFrame:
    got = shots.group_into_shots(assets(spark, d))
    return got.select("stem", F.size("assets").cast("long").alias("n_assets"), "needs_derivation", F.array_join(F.col("assets.rel_path"), ",").alias("paths"))


@query(f"WITH {ASSET} SELECT stem, sha256(concat(sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)), ':', sum(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT)))) AS fingerprint, count(*) AS n FROM (SELECT stem, sha256(concat(length(rel_path), ':', rel_path, length(CAST(bytes AS VARCHAR)), ':', bytes)) AS h FROM a) GROUP BY stem")
def set_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return shots.set_fingerprint(assets(spark, d), ["stem"], ["rel_path", "bytes"])


NOW = EPOCH + 30 * 86_400
SHOT = """s AS (SELECT o_orderkey AS shot, o_custkey % 40 AS card, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE epoch_us(o_orderdate) // 1000000 END AS capture,
CAST(o_totalprice AS BIGINT) AS bytes, CAST(o_orderkey % 5000 AS BIGINT) AS width, CAST(o_custkey % 5000 AS BIGINT) AS height, o_orderkey % 7 <> 0 AS has_location FROM orders)"""
DATE_LIMIT, BYTES_LIMIT, PIXELS = 10_500, 250_000, 6.0
MEDIANS = "md AS (SELECT card, list_sort(list(capture))[count(capture) // 2 + 1] AS median, max(has_location) AS any_location, max(capture) - min(capture) AS spread FROM s GROUP BY card)"
CHECKS = f"""WITH {SHOT}, {MEDIANS}, x AS (SELECT s.*, median, any_location, spread, abs(capture - {NOW}) // 86400 AS age, abs(median - {NOW}) // 86400 AS m_age, abs(capture - median) // 86400 AS off FROM s JOIN md USING (card)),
c AS (SELECT card, shot, 'date' AS rule, CASE WHEN capture IS NULL OR age > {DATE_LIMIT} THEN 'fail' WHEN off > 30 THEN 'warn' ELSE 'pass' END AS status,
 CASE WHEN capture IS NULL THEN 'no_date' WHEN age > {DATE_LIMIT} THEN CASE WHEN m_age > {DATE_LIMIT} AND spread // 86400 < 30 THEN 'date_out_of_range_batch' ELSE 'date_out_of_range' END WHEN off > 30 THEN 'date_outlier' END AS failure FROM x
UNION ALL SELECT card, shot, 'location', CASE WHEN NOT has_location AND any_location THEN 'warn' ELSE 'pass' END, CASE WHEN NOT has_location AND any_location THEN 'no_location' END FROM x
UNION ALL SELECT card, shot, 'resolution', CASE WHEN width <= 0 OR height <= 0 THEN 'warn' WHEN width * height > {int(PIXELS * 1e6)} THEN 'fail' ELSE 'pass' END, CASE WHEN width <= 0 OR height <= 0 THEN 'dimensions_unknown' WHEN width * height > {int(PIXELS * 1e6)} THEN 'too_many_pixels' END FROM x
UNION ALL SELECT card, shot, 'size', CASE WHEN bytes > {BYTES_LIMIT} THEN 'fail' ELSE 'pass' END, CASE WHEN bytes > {BYTES_LIMIT} THEN 'too_large' END FROM x)"""


def order_shots(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("shot"),
        (F.col("o_custkey") % 40).alias("card"),
        F.when(F.col("o_orderkey") % 11 != 0, dates.seconds(F.col("o_orderdate"))).alias("capture"),
        F.round("o_totalprice").cast("long").alias("bytes"),
        (F.col("o_orderkey") % 5000).alias("width"),
        (F.col("o_custkey") % 5000).alias("height"),
        (F.col("o_orderkey") % 7 != 0).alias("has_location"),
    )


def shot_checks(spark: SparkSession, d: str) -> DataFrame:
    return checks.validate(order_shots(spark, d), card="card", ident="shot", now=NOW, max_age_days=DATE_LIMIT, max_bytes=BYTES_LIMIT, megapixels=PIXELS)


@query(f"{CHECKS} SELECT * FROM c")
def validate_rules(spark: SparkSession, d: str) -> DataFrame:
    return shot_checks(spark, d)


@query(f"{CHECKS} SELECT shot, CASE max(CASE status WHEN 'pass' THEN 0 WHEN 'pending' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END) WHEN 0 THEN 'pass' WHEN 1 THEN 'pending' WHEN 2 THEN 'warn' ELSE 'fail' END AS status FROM c GROUP BY shot")
def worst_status(spark: SparkSession, d: str) -> DataFrame:
    return checks.worst_status(shot_checks(spark, d), ["shot"])


@query(f"{CHECKS} SELECT failure, count(*) AS n, min(shot) AS first_id, max(shot) AS last_id FROM c WHERE failure IS NOT NULL GROUP BY failure")
def by_failure(spark: SparkSession, d: str) -> DataFrame:
    return checks.by_failure(shot_checks(spark, d), "shot")


@query(f"{CHECKS} SELECT DISTINCT shot FROM c WHERE failure = 'too_large'")
def grid_filter(spark: SparkSession, d: str) -> DataFrame:
    """Shots that have a check with one failure."""
    return shot_checks(spark, d).where("failure = 'too_large'").select("shot").distinct()


@query(f"{CHECKS} SELECT card, count_if(status = 'fail') AS failing, count_if(status = 'pass') AS passing, count_if(status = 'warn') AS warned FROM c GROUP BY card")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return shot_checks(spark, d).groupBy("card").agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("fail", "failing"), ("pass", "passing"), ("warn", "warned"))))


@query(f"""WITH e AS (SELECT user_id % 20 AS card, epoch_us(ts) // 1000000 AS capture FROM events), l AS (SELECT card, list_sort(list(capture)) AS v FROM e GROUP BY card), m AS (SELECT card, len(v) AS affected, v[len(v) // 2 + 1] AS med, v[-1] - v[1] AS spread FROM l),
w AS (SELECT *, {EPOCH + 400 * 86400} - med AS d FROM m WHERE abs(med - {EPOCH + 400 * 86400}) // 86400 > 90 AND spread // 86400 < 30)
SELECT card, affected, format('{{}}0:0:{{}} {{}}:{{}}:{{}}', CASE WHEN d < 0 THEN '-' ELSE '+' END, abs(d) // 86400, abs(d) % 86400 // 3600, abs(d) % 3600 // 60, abs(d) % 60) AS shift FROM w""")
def clock_offset_check(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select((F.col("user_id") % 20).alias("card"), F.col("at").alias("capture"))
    return checks.clock_offset(rows, "card", EPOCH + 400 * 86_400, 90)


@query("SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0) AND doc_id % 5 <> 0")
def published_semi(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose bytes are published already (every fifth one is)."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return ledger.published_among(rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0"), "sha256").select("doc_id")


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0) AND doc_id % 5 <> 0")
def unpublished_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return ledger.unpublished(rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0"), "sha256").select("doc_id")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS sha, n_chars AS bytes FROM documents), p AS (SELECT DISTINCT sha FROM h WHERE doc_id % 5 = 0), s AS (SELECT sha, max(bytes + doc_id % 2) AS size FROM h WHERE doc_id % 3 = 0 GROUP BY sha)
SELECT doc_id, CASE WHEN p.sha IS NOT NULL THEN 'already_published' WHEN s.size = h.bytes THEN 'already_staged' ELSE 'send' END AS disposition FROM h LEFT JOIN p USING (sha) LEFT JOIN s USING (sha)""")
def session_disposition(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("bytes"))
    staged = rows.where("doc_id % 3 = 0").withColumn("bytes", F.col("bytes") + F.col("doc_id") % 2)
    return checks.disposition(rows, rows.where("doc_id % 5 = 0"), staged, "sha").select("doc_id", "disposition")


@query("""SELECT o_orderkey AS name, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' WHEN o_orderkey % 8 = 0 THEN 'short_file' WHEN o_orderkey % 7 = 0 THEN 'hash_mismatch' ELSE 'verified' END AS outcome FROM orders""")
def arrival_verify(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    sent = table(spark, d, "orders").select(k.alias("name"), (k * 10).alias("bytes"), F.sha2(k.cast("string"), 256).alias("sha256"))
    n = F.col("name")
    there = sent.where(n % 9 != 0).withColumn("bytes", F.when(n % 8 == 0, F.col("bytes") - 1).otherwise(F.col("bytes"))).withColumn("sha256", F.when(n % 7 == 0, F.lit("other")).otherwise(F.col("sha256")))
    return checks.verify_arrivals(sent, there, "name").select("name", "outcome")


INCOMING = f"""WITH {POS}, u AS (SELECT event_id AS t_at, lat, lon, ele, user_id FROM pos), held AS (SELECT t_at, lat, lon, ele, concat('h', user_id) AS track_id FROM u WHERE t_at % 3 <> 0),
inc AS (SELECT t_at, CASE WHEN t_at % 10 = 0 THEN lat + 0.25 ELSE lat + 0.0000004 END AS lat, lon, ele, 'new' AS track_id FROM u WHERE t_at % 2 = 0),
d AS (SELECT inc.*, held.lat AS h_lat, held.lon AS h_lon, CASE WHEN held.t_at IS NULL THEN 'new' WHEN abs(inc.lat - held.lat) <= 1e-6 AND abs(inc.lon - held.lon) <= 1e-6 THEN 'identical' ELSE 'conflict' END AS bucket FROM inc LEFT JOIN held ON inc.t_at = held.t_at)"""


def imports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = positions(spark, d).select(F.col("event_id").alias("at"), "lat", "lon", "ele", "user_id")
    held = rows.where("at % 3 <> 0").select("at", "lat", "lon", "ele", F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("track_id"))
    moved = F.when(F.col("at") % 10 == 0, F.col("lat") + 0.25).otherwise(F.col("lat") + 0.0000004)
    return rows.where("at % 2 = 0").select("at", moved.alias("lat"), "lon", "ele", F.lit("new").alias("track_id")), held


@query(f"""{INCOMING} SELECT bucket, count(*) AS n, round(sum(CASE WHEN bucket = 'conflict' THEN 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(h_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(h_lat)) * pow(sin(radians(h_lon - lon) / 2), 2)))) END), 1) AS metres FROM d GROUP BY bucket""")
def import_diff_buckets(spark: SparkSession, d: str) -> DataFrame:
    new, held = imports(spark, d)
    return timeline.diff(new, held).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("distance"), 1).alias("metres"))


@query(f"""{INCOMING}, taken AS (SELECT t_at, lat, lon, ele, track_id FROM d WHERE bucket = 'new' OR (bucket = 'conflict' AND t_at % 20 = 0))
SELECT t_at AS at_s, round(lat, 6) AS lat, round(lon, 6) AS lon, ele, track_id FROM taken UNION ALL SELECT t_at, round(lat, 6), round(lon, 6), ele, track_id FROM held WHERE t_at NOT IN (SELECT t_at FROM taken)""")
def import_commit(spark: SparkSession, d: str) -> DataFrame:
    """The merged timeline: conflicts keep what is held, but every other one is overridden."""
    new, held = imports(spark, d)
    overrides = new.where("at % 20 = 0").select("at", F.lit("replace").alias("choice"))
    merged, _ = timeline.commit(new, held, "keep", overrides)
    return merged.select(F.col("at").alias("at_s"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "ele", "track_id")


@query(f"{INCOMING} SELECT t_at AS at_s FROM u WHERE t_at % 20 = 0 AND t_at NOT IN (SELECT t_at FROM d WHERE bucket = 'conflict')")
def stale_overrides(spark: SparkSession, d: str) -> DataFrame:
    new, held = imports(spark, d)
    overrides = new.where("at % 20 = 0").select("at", F.lit("replace").alias("choice"))
    return timeline.commit(new, held, "keep", overrides)[1].select(F.col("at").alias("at_s"))


@query("""WITH l AS (SELECT c_custkey AS id, c_custkey % 100 AS imported_at, c_custkey % 4 <> 0 AS has_text FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT c_custkey AS id, c_custkey % 90 AS imported_at, c_custkey % 6 <> 0 AS has_text FROM customer WHERE c_custkey % 3 = 0),
lg AS (SELECT c_custkey AS id, 50 AS deleted_at FROM customer WHERE c_custkey % 5 = 0), rg AS (SELECT c_custkey AS id, 40 AS deleted_at FROM customer WHERE c_custkey % 7 = 0),
j AS (SELECT coalesce(l.id, r.id) AS id, l.id IS NOT NULL AS h, r.id IS NOT NULL AS t, coalesce(l.has_text, false) AS lt, coalesce(r.has_text, false) AS rt, l.id IS NOT NULL AND coalesce(rg.deleted_at > l.imported_at, false) AS dh, r.id IS NOT NULL AND coalesce(lg.deleted_at > r.imported_at, false) AS dt
 FROM l FULL JOIN r ON l.id = r.id LEFT JOIN lg ON lg.id = coalesce(l.id, r.id) LEFT JOIN rg ON rg.id = coalesce(l.id, r.id))
SELECT id, t AND NOT h AND NOT dt AND rt AS pull, h AND NOT t AND NOT dh AND lt AS push, dh AS delete_here, dt AS delete_there, (h AND NOT t AND NOT dh AND NOT lt) OR (t AND NOT h AND NOT dt AND NOT rt) AS unsendable FROM j""")
def replica_sync_plan(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    k = F.col("id")
    local = c.where("id % 2 = 0").select("id", (k % 100).alias("imported_at"), (k % 4 != 0).alias("has_text"))
    remote = c.where("id % 3 = 0").select("id", (k % 90).alias("imported_at"), (k % 6 != 0).alias("has_text"))
    return timeline.sync_plan(local, remote, c.where("id % 5 = 0").withColumn("deleted_at", F.lit(50)), c.where("id % 7 = 0").withColumn("deleted_at", F.lit(40)))


MERGE = "WITH held AS (SELECT o_orderkey AS k, o_orderstatus AS v, 0 AS seq FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT l_orderkey AS k, l_linestatus AS v, l_linenumber AS seq FROM lineitem WHERE l_orderkey % 2 = 0)"


def merge_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    held = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.lit(0).alias("seq"))
    new = table(spark, d, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("v"), F.col("l_linenumber").alias("seq"))
    return held, new


@query(f"{MERGE}, f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq, v) AS n FROM new WHERE k NOT IN (SELECT k FROM held)) SELECT * FROM held UNION ALL SELECT k, v, seq FROM f WHERE n = 1")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    held, new = merge_inputs(spark, d)
    return ledger.insert_or_ignore(held, new, ["k"], [F.col("seq"), F.col("v")])


@query(f"{MERGE}, f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, v) AS n FROM new) SELECT k, v, seq FROM f WHERE n = 1 UNION ALL SELECT * FROM held WHERE k NOT IN (SELECT k FROM new)")
def insert_or_replace(spark: SparkSession, d: str) -> DataFrame:
    held, new = merge_inputs(spark, d)
    return ledger.insert_or_replace(held, new, ["k"], [-F.col("seq"), F.col("v")])


@query("""WITH h AS (SELECT c_custkey AS k, c_name AS label, 1 AS first_seen, 1 AS last_seen FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS label, 2 AS first_seen, 2 AS last_seen FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(h.k, n.k) AS k, coalesce(n.label, h.label) AS label, coalesce(h.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, h.last_seen) AS last_seen FROM h FULL JOIN n ON h.k = n.k""")
def upsert_first_seen(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    held = c.where(k % 2 == 0).select(k.alias("k"), F.col("c_name").alias("label"), F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"))
    new = c.where(k % 3 == 0).select(k.alias("k"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("label"), F.lit(2).alias("first_seen"), F.lit(2).alias("last_seen"))
    return ledger.upsert(held, new, ["k"], keep_old=["first_seen"], keep_old_if_null=["label"])


@query("SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the children once some parents are gone."""
    parents = table(spark, d, "orders")
    _, left = ledger.cascade_delete(parents, table(spark, d, "lineitem"), parents.where("o_orderstatus = 'F'"), "o_orderkey", "l_orderkey")
    return left.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, role, n AS n_events FROM r WHERE k = 1")
def publish_state_fold(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "conversations").withColumn("seq", F.struct("turn", "role"))
    return ledger.fold_states(log, "conv_id", "seq", ["turn", "role"])


@query("SELECT conv_id, count_if(role = 'user') AS n_user, count_if(role = 'assistant') AS n_assistant, count_if(role NOT IN ('user', 'assistant')) AS n_other FROM conversations GROUP BY conv_id")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    role = F.col("role")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(role == "user").alias("n_user"), F.count_if(role == "assistant").alias("n_assistant"), F.count_if(~role.isin("user", "assistant")).alias("n_other"))


@query("WITH r AS (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 50 AS batch, o_orderstatus FROM orders) SELECT o_orderstatus, batch, count(*) AS n, min(o_orderkey) AS first_key FROM r GROUP BY ALL")
def batch_of_50(spark: SparkSession, d: str) -> DataFrame:
    got = ledger.batches_of(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderkey"], 50, ["o_orderstatus"])
    return got.groupBy("o_orderstatus", "batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT o_orderkey, greatest(30.0, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END, 30 * pow(2.0, least(o_orderkey % 8, 4)))) AS wait_s FROM orders")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", ledger.backoff_seconds(F.when(k % 4 == 0, k % 100), k % 8).alias("wait_s"))


@query("WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), g AS (SELECT *, min(doc_id) OVER (PARTITION BY sha256) AS first_id, count(*) OVER (PARTITION BY sha256) AS n FROM h) SELECT * FROM g WHERE n > 1")
def content_sha_dedup(spark: SparkSession, d: str) -> DataFrame:
    return shots.content_copies(table(spark, d, "documents"), "text", "doc_id")


RENAME = "WITH r AS (SELECT concat(p_name, '-', p_partkey, '.jpg') AS name, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS capture, p_partkey FROM part)"


@query(f"""{RENAME}, n AS (SELECT name, row_number() OVER (ORDER BY capture NULLS FIRST, TRY_CAST(nullif(regexp_extract(name, '([0-9]+)', 1), '') AS DECIMAL(20, 0)) NULLS FIRST, name) AS place, count(*) OVER () AS total FROM r),
m AS (SELECT name, place, concat('trip-', lpad(CAST(place AS VARCHAR), CAST(greatest(2, length(CAST(total AS VARCHAR))) AS INTEGER), '0'), '.jpg') AS new_name FROM n) SELECT name, place, new_name, CASE WHEN place % 100 = 0 THEN 'collision' END AS problem FROM m""")
def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    rows = p.select(F.concat_ws("", "p_name", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("capture"))
    total = p.count()
    width = max(2, len(str(total)))
    taken = spark.range(100, total + 1, 100).select(F.concat(F.lit("trip-"), F.lpad(F.col("id").cast("string"), width, "0"), F.lit(".JPG")).alias("name"))
    return shots.rename_plan(rows, name="name", capture="capture", prefix="trip", existing=taken)


@query("WITH r AS (SELECT p_partkey, lower(concat(p_brand, p_size)) AS t FROM part) SELECT p_partkey, p_partkey = min(p_partkey) OVER (PARTITION BY t) AS claim FROM r")
def first_claimant(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.col("p_size").cast("string")).alias("target"))
    return shots.first_claimant(rows, "target", ["p_partkey"]).select("p_partkey", "claim")


@query("WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM r WHERE i IN (SELECT k * (n - 1) // 6 FROM (SELECT unnest(range(7)) AS k))")
def sample_evenly(spark: SparkSession, d: str) -> DataFrame:
    return shots.sample_evenly(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 7)


@query("SELECT c_custkey, TRY_CAST(nullif(regexp_extract(c_name, '([0-9]+)', 1), '') AS DECIMAL(20, 0)) AS number FROM customer")
def leading_integer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.leading_number(F.col("c_name")).alias("number"))


@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN '2024-01' END, regexp_replace(replace(regexp_replace(c_mktsegment, '\\s', '', 'g'), '_', '-'), '[^A-Za-z0-9-]', '', 'g'), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x' END], lambda x: x IS NOT NULL AND x <> ''), '-') AS prefix FROM customer")
def prefix_build(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    prefix = text.build_prefix(F.when(k % 2 == 0, "2024-01"), text.sanitise_block(F.col("c_mktsegment")), F.when(k % 3 == 0, "").otherwise("x"))
    return table(spark, d, "customer").select("c_custkey", prefix.alias("prefix"))


@query("""WITH m AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN concat('img', p_partkey, '.jpg') ELSE concat('img', p_partkey, '(1).jpg') END AS name FROM part)
SELECT k, CASE k % 3 WHEN 0 THEN concat(name, '.json') WHEN 1 THEN concat('img', k, '.jpg(1).json') ELSE concat('img', k, '.jpg.json') END AS sidecar FROM m WHERE k % 4 <> 0""")
def sidecar_match(spark: SparkSession, d: str) -> DataFrame:
    """Each picture's sidecar: the first of its candidate names that exists."""
    k = F.col("p_partkey")
    n = F.concat(F.lit("img"), k.cast("string"))
    media = table(spark, d, "part").select(k.alias("k"), F.when(k % 3 == 0, F.concat(n, F.lit(".jpg"))).otherwise(F.concat(n, F.lit("(1).jpg"))).alias("name"))
    there = table(spark, d, "part").where(k % 4 != 0).select(F.when(k % 3 == 1, F.concat(n, F.lit(".jpg(1).json"))).otherwise(F.concat(n, F.lit(".jpg.json"))).alias("sidecar"))
    tries = media.select("k", F.posexplode(text.sidecar_candidates(F.col("name"))).alias("place", "sidecar"))
    return tries.join(there, "sidecar").groupBy("k").agg(F.min_by("sidecar", "place").alias("sidecar"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN epoch_us(date_trunc('day', o_orderdate)) // 1000000 ELSE epoch_us(o_orderdate) // 1000000 END AS at_s FROM orders""")
def normalise_datetime(spark: SparkSession, d: str) -> DataFrame:
    """Dates as cameras write them: colons, zones, fractions, bare dates and zeros."""
    k, ts = F.col("o_orderkey"), F.col("o_orderdate")
    written = F.when(k % 5 == 0, "0000:00:00 00:00:00").when(k % 5 == 1, F.date_format(ts, "yyyy:MM:dd")).when(k % 5 == 2, F.date_format(ts, "yyyy:MM:dd HH:mm:ss")).when(k % 5 == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(".25")))
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(dates.normalise_datetime(written)).alias("at_s"))


@query("SELECT o_orderkey, epoch_us(o_orderdate + INTERVAL 13 MONTH + INTERVAL 1 DAY + INTERVAL 3723 SECOND) // 1000000 AS at_s FROM orders")
def shift_delta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(dates.apply_shift(F.col("o_orderdate").cast("timestamp"), dates.shift_parts(F.lit("+1:1:1 1:2:3")))).alias("at_s"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 17 <= 14 THEN (CASE WHEN o_orderkey % 3 = 1 THEN -1 ELSE 1 END) * (o_orderkey % 17 * 60 + o_custkey % 60) END AS minutes FROM orders")
def utc_offset_parse(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of up to 14 hours and any minutes: with a sign or without, padded or not, some in quotes."""
    k = F.col("o_orderkey")
    hours, minutes = (k % 17).cast("string"), (F.col("o_custkey") % 60).cast("string")
    written = F.concat(F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("")), (k % 3 + 1).cast("int")), F.when(k % 2 == 0, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), F.lpad(minutes, 2, "0"))
    written = F.when(k % 5 == 0, F.concat(F.lit('"'), written, F.lit('"'))).otherwise(written)
    return table(spark, d, "orders").select("o_orderkey", dates.utc_offset_minutes(written).alias("minutes"))


@query(f"WITH {EV} SELECT event_id, CAST(floor((t_at - {EPOCH + 864000} + 3600) / 86400.0) AS BIGINT) AS day, strftime(make_timestamp((t_at + 3600) * 1000000), '%Y-%m-%d') AS local_date FROM ev")
def local_day(spark: SparkSession, d: str) -> DataFrame:
    """Local days, before the epoch too, and local dates."""
    at = F.col("at")
    return events(spark, d).select("event_id", dates.local_day(at - (EPOCH + 864_000), 3600).alias("day"), dates.local_date(at, 3600).alias("local_date"))


@query(f"""WITH {POS}, n AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM pos WINDOW w AS (PARTITION BY user_id ORDER BY t_at, event_id))
SELECT event_id, round(2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))), 2) AS metres FROM n""")
def haversine(spark: SparkSession, d: str) -> DataFrame:
    rows = with_neighbour(positions(spark, d), ["user_id"], ["at", "event_id"], {"lat0": "lat", "lon0": "lon"})
    return rows.select("event_id", F.round(geo.metres_between(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 2).alias("metres"))


@query("""SELECT o_orderkey, CASE WHEN w * h > 6000000 THEN greatest(1, CAST(floor(w * sqrt(6e6 / (w * h))) AS INTEGER)) END AS width, CASE WHEN w * h > 6000000 THEN greatest(1, CAST(floor(h * sqrt(6e6 / (w * h))) AS INTEGER)) END AS height
FROM (SELECT o_orderkey, CAST(o_orderkey % 6000 + 1 AS DOUBLE) AS w, CAST(o_custkey % 4000 + 1 AS DOUBLE) AS h FROM orders)""")
def resize_dims(spark: SparkSession, d: str) -> DataFrame:
    fit = geo.fit_megapixels(F.col("o_orderkey") % 6000 + 1, F.col("o_custkey") % 4000 + 1, 6.0)
    return table(spark, d, "orders").select("o_orderkey", fit["width"].alias("width"), fit["height"].alias("height"))


@query("""WITH i AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000000 AS a, epoch_us(o_orderdate) // 1000000 + (o_orderkey % 400 - 5) * 86400 AS b FROM orders), n AS (SELECT *, lead(a) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey) AS nxt FROM i)
SELECT o_custkey, o_orderkey, CASE WHEN b < a THEN 'inverted' ELSE 'overlaps next' END AS problem FROM n WHERE b < a OR nxt < b""")
def stop_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    start = dates.seconds(F.col("o_orderdate"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", start.alias("a"), (start + (F.col("o_orderkey") % 400 - 5) * 86_400).alias("b"))
    return asof.overlapping(rows, ["o_custkey"], "a", "b", "o_orderkey").select("o_custkey", "o_orderkey", "problem")


EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)"
PIX = f"{EMB}, px AS (SELECT vec_id, list_transform(a, lambda x: CAST(greatest(0, least(255, floor((x + 1) * 127.5))) AS INTEGER)) AS p FROM e)"


def rasters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    return e.withColumn("p", F.transform("a", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 1) * 127.5))).cast("int")))


@query(f"WITH {EMB}, u AS (SELECT unnest(a) AS v, unnest(range(len(a))) AS x FROM e) SELECT CAST(x AS INTEGER) AS x, round(avg(v), 6) AS mean FROM u GROUP BY x")
def array_profile(spark: SparkSession, d: str) -> DataFrame:
    return arrays.column_profile(rasters(spark, d), "a").select("x", F.round("mean", 6).alias("mean"))


@query(f"WITH {EMB} SELECT vec_id, len(list_filter(a, lambda x: x >= 0.1)) / len(a) AS above, len(list_filter(a, lambda x: x <= -0.1)) / len(a) AS below FROM e")
def fraction_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rasters(spark, d).select("vec_id", arrays.fraction_at_or_above(F.col("a"), 0.1).alias("above"), arrays.fraction_at_or_below(F.col("a"), -0.1).alias("below"))


@query(f"WITH {EMB} SELECT vec_id, CAST(coalesce(list_min(list_filter(list_transform(range(len(a)), lambda i: CASE WHEN a[i + 1] > 0.05 THEN i END), lambda i: i IS NOT NULL)), len(a)) AS INTEGER) AS run FROM e")
def border_run(spark: SparkSession, d: str) -> DataFrame:
    return rasters(spark, d).select("vec_id", arrays.border_run(F.col("a"), 0.05).cast("int").alias("run"))


@query(f"WITH {EMB} SELECT vec_id, CAST(list_position(a[5:60], list_min(a[5:60])) - 1 + 4 AS BIGINT) AS place FROM e")
def darkest_index(spark: SparkSession, d: str) -> DataFrame:
    return rasters(spark, d).select("vec_id", arrays.first_minimum(F.col("a"), 4).alias("place"))


@query(f"WITH {PIX} SELECT vec_id, list_sum(list_transform(range(len(p)), lambda i: list_min(p[greatest(i - 2, 0) + 1 : least(i + 2, len(p) - 1) + 1]))) AS total FROM px")
def sliding_min(spark: SparkSession, d: str) -> DataFrame:
    low = arrays.sliding_min(F.col("p"), 2)
    return rasters(spark, d).select("vec_id", F.aggregate(low, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"WITH {PIX}, c AS (SELECT v AS bin, count(*) AS n FROM (SELECT unnest(p) AS v FROM px) GROUP BY v) SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(256)) AS b) LEFT JOIN c ON c.bin = b")
def histogram_256(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram_256(rasters(spark, d).select(F.explode("p").alias("v")), [], "v")


@query(f"WITH {PIX}, u AS (SELECT vec_id % 10 AS image, unnest(p) AS v FROM px), l AS (SELECT image, list_sort(list(v)) AS s FROM u GROUP BY image) SELECT image, s[CAST(greatest(1, ceil(len(s) * 0.95)) AS BIGINT)] AS bin FROM l")
def luma_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = rasters(spark, d).select((F.col("vec_id") % 10).alias("image"), F.explode("p").alias("v"))
    return stats.histogram_percentile(stats.histogram_256(rows, ["image"], "v"), ["image"], 0.95)


@query(f"WITH {PIX} SELECT vec_id, CAST(len(list_filter(p, lambda x: x <= 100)) AS INTEGER) AS shadows, CAST(len(list_filter(p, lambda x: x >= 155)) AS INTEGER) AS highlights FROM px")
def clip_counts(spark: SparkSession, d: str) -> DataFrame:
    c = arrays.clip_counts(F.col("p"), 100, 155)
    return rasters(spark, d).select("vec_id", c["shadows"].alias("shadows"), c["highlights"].alias("highlights"))


RGB = f"{EMB}, c AS (SELECT vec_id, greatest(0, least(1, abs(a[1]) * 4)) AS r, greatest(0, least(1, abs(a[2]) * 4)) AS g, greatest(0, least(1, abs(a[3]) * 4)) AS b FROM e)"


def colours(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda i: colour.clamp(F.abs(F.col("a")[i]) * 4)
    return rasters(spark, d).select("vec_id", pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))


def _lin(x: str) -> str:
    return f"CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END"


@query(f"WITH {RGB} SELECT vec_id, round({_lin('r')}, 6) AS linear, round(r, 6) AS again FROM c")
def srgb_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lin = colour.srgb_to_linear(F.col("r"))
    return colours(spark, d).select("vec_id", F.round(lin, 6).alias("linear"), F.round(colour.linear_to_srgb(lin), 6).alias("again"))


def _dot(row: tuple, names: tuple) -> str:
    return " + ".join(f"({k}) * {n}" for k, n in zip(row, names, strict=True))


@query(
    f"WITH {RGB}, m AS (SELECT vec_id, {', '.join(f'cbrt({_dot(row, ("r", "g", "b"))}) AS {n}' for row, n in zip(colour.TO_LMS, 'lms', strict=True))} FROM c) SELECT vec_id, {', '.join(f'round({_dot(row, ("l", "m", "s"))}, 5) AS {n}' for row, n in zip(colour.LMS_TO_LAB, ('lab_l', 'lab_a', 'lab_b'), strict=True))} FROM m"
)
def oklab(spark: SparkSession, d: str) -> DataFrame:
    lab = colour.oklab(F.col("r"), F.col("g"), F.col("b"))
    return colours(spark, d).select("vec_id", *(F.round(v, 5).alias(n) for v, n in zip(lab, ("lab_l", "lab_a", "lab_b"), strict=True)))


def _smooth(lo: float, hi: float, x: str) -> str:
    t = f"greatest(0, least(1, ({x} - {lo}) / ({hi} - {lo})))"
    return f"({t} * {t} * (3 - 2 * {t}))"


@query(f"WITH {RGB} SELECT vec_id, round({_smooth(0.18, 0.65, 'r')}, 6) AS highlights, round(1 - {_smooth(0.05, 0.18, 'r')}, 6) AS shadows FROM c")
def tone_weights(spark: SparkSession, d: str) -> DataFrame:
    high, low = colour.tone_weights(F.col("r"))
    return colours(spark, d).select("vec_id", F.round(high, 6).alias("highlights"), F.round(low, 6).alias("shadows"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^\\p{L}\\p{N}]', '-', 'g') AS slug FROM pages")
def url_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.slug(text.base_name(F.col("url"))).alias("slug"))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{d}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame) -> DataFrame:
    """What a stream has written once all there is has been read: Parquet in the shared folder."""
    return stage_stream(stream, "sink")


@query("""WITH w AS (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1) SELECT epoch_us(d) // 1000000 AS day_s, n FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_closed_days(spark: SparkSession, d: str) -> DataFrame:
    """Days that a stream of all events has closed."""
    return drained(rollup.closed_days(event_stream(spark, d)).select(F.unix_seconds("day_start").alias("day_s"), "n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g), b AS (SELECT user_id, burst, min(ts) AS a, max(ts) AS z, count(*) AS n FROM n GROUP BY ALL)
SELECT user_id, epoch_us(a) // 1000000 AS first_s, n FROM b WHERE z + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)""")
def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of each user that six quiet hours have ended."""
    bursts = rollup.quiet_keys(event_stream(spark, d), "user_id", quiet="6 hours")
    return drained(bursts.select("user_id", F.unix_seconds("first_ts").alias("first_s"), "n"))


@query("SELECT event_id FROM events")
def stream_once_each(spark: SparkSession, d: str) -> DataFrame:
    """A stream that reads every event twice, and keeps it once."""
    twice = event_stream(spark, d).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return drained(rollup.once_each(twice, ["event_id"], grace="60 days").select("event_id"))


@query()
def raster_blur(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 rasters, smoothed and brought down to 4 x 4."""
    rows = rasters(spark, d).select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("a").alias("pixels"))
    got = raster.map_rasters(rows, lambda x: raster.resize(raster.gaussian_blur(x, 1.0), 4, 4))
    return got.select("id", "width", F.transform("pixels", lambda p: F.round(p, 6)).alias("pixels"))


@query()
def lut_3d(spark: SparkSession, d: str) -> DataFrame:
    """Colours through a small lattice by tetrahedral interpolation."""
    axis = np.linspace(0, 1, 5)
    lattice = np.stack(np.meshgrid(axis**0.8, axis, axis**1.2, indexing="ij"), -1)
    look = tables.apply_lattice(spark, lattice)
    return colours(spark, d).select("vec_id", look("r", "g", "b").alias("c")).select("vec_id", *(F.round(f"c.{k}", 6).alias(k) for k in "rgb"))


@query()
def curve_eval(spark: SparkSession, d: str) -> DataFrame:
    """A monotone tone curve at each red value."""
    curve = tables.monotone_cubic([(0, 0), (0.25, 0.2), (0.75, 0.85), (1, 1)])
    return colours(spark, d).select("vec_id", F.round(tables.evaluate_curve(curve, F.col("r")), 6).alias("value"))


@query()
def colour_difference(spark: SparkSession, d: str) -> DataFrame:
    """CIEDE2000 between neighbouring pairs of components read as Lab."""
    part = lambda i, k: F.col("a")[i] * k
    lab = [part(0, 100.0), part(1, 100.0), part(2, 100.0), part(3, 100.0), part(4, 100.0), part(5, 100.0)]
    return rasters(spark, d).select("vec_id", F.round(colour.delta_e_2000(*lab), 4).alias("difference"))


@query("""WITH h AS (SELECT sha256(concat(length(CAST(doc_id AS VARCHAR)), ':', doc_id, coalesce(concat(length(source), ':', source), '-'))) AS h FROM documents WHERE doc_id % 5 = 0)
SELECT count(*) AS n, sha256(concat(sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)), ':', sum(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT)))) AS plan_hash FROM h""")
def plan_hash(spark: SparkSession, d: str) -> DataFrame:
    """How many actions a plan has, and their hash."""
    rows = table(spark, d, "documents").select("doc_id", "source")
    plan = Plan.of(rows, first_reason((F.col("doc_id") % 5 != 0, "published")))
    return plan.fingerprint(["doc_id", "source"])
