"""Registered queries over streams with state, feeds and sinks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import drained, event_stream, query, table
from .operators.intervals import nested_intervals
from .sources import documents, feed
from .staging import kept_path
from .streaming import timers

#: Events as fixes of their user's device.
LAT, LON = "(user_id * 7919 % 17000) / 100.0 - 85", "(event_id * 104729 % 35000) / 100.0 - 175"


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS starts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g), b AS (SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS n FROM n GROUP BY user_id, burst)
SELECT user_id, epoch_us(a) // 1000000 AS first_s, epoch_us(z) // 1000000 AS last_s, n FROM b WHERE z + INTERVAL 8 HOUR <= (SELECT max(ts) FROM events)""")
def timer_quiet_keys(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of each user that a timer has ended after eight quiet hours."""
    bursts = timers.quiet_keys(event_stream(spark, d), "user_id", quiet_seconds=8 * 3600)
    return drained(bursts.select("user_id", F.unix_seconds("first_ts").alias("first_s"), F.unix_seconds("last_ts").alias("last_s"), F.col("n")))


@query(f"""WITH f AS (SELECT user_id, epoch_us(ts) // 1000000 AS t_at, {LAT} AS lat, {LON} AS lon, event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, t_at ORDER BY event_id) = 1)
SELECT user_id AS device, t_at - t_at % 86400 AS day, 1 AS track, count(*) AS n, min(t_at) AS first_at, max(t_at) AS last_at,
sha256(string_agg(concat(t_at, ':', printf('%.7f', CAST(lat AS DOUBLE)), ':', printf('%.7f', CAST(lon AS DOUBLE))), chr(10) ORDER BY t_at)) AS track_id
FROM o GROUP BY 1, 2 HAVING make_timestamp((min(t_at) - min(t_at) % 86400 + 86400 + 7200) * 1000000) <= (SELECT max(ts) FROM events)""")
def timer_due_days(spark: SparkSession, d: str) -> DataFrame:
    """Each user's days, written up by a timer two hours after the day's end."""
    rows = event_stream(spark, d)
    fixes = rows.select(F.col("user_id").alias("device"), F.unix_seconds("ts").alias("at"), F.expr(f"double({LAT})").alias("lat"), F.expr(f"double({LON})").alias("lon"), F.col("event_id").alias("received_at"), "ts")
    return drained(timers.due_days(fixes))


@query(f"""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 AS t_at, {LAT} AS lat, {LON} AS lon FROM events)
SELECT event_id AS ele, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS device, t_at AS "at",
CASE WHEN event_type = 'view' THEN 'another kind' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'time or place missing' WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'place out of range' END AS reason FROM e""")
def report_feed(spark: SparkSession, d: str) -> DataFrame:
    """Events as device reports in a folder of files, read by the streaming source."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "waypoint").otherwise("location")
    lat = F.when(~((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0)), F.expr(f"double({LAT})") + F.when((F.col("event_type") == "click") & (F.col("event_id") % 4 == 0), 200.0).otherwise(0.0))
    device = F.when(F.col("event_type") == "error", " ").otherwise(F.col("user_id").cast("string"))
    report = F.struct(kind.alias("_type"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("tst"), lat.alias("lat"), F.expr(f"double({LON})").alias("lon"), F.col("event_id").alias("alt"), device.alias("tid"))
    folder = kept_path(spark, "reports")
    e.select(F.to_json(report)).write.text(folder)
    rows = feed.report_stream(spark, folder, files_per_task="1")
    return drained(rows.select(F.col("ele").cast("long").alias("ele"), "device", "at", "reason"))


@query(f"""WITH f AS (SELECT user_id, epoch_us(ts) // 1000000 AS t_at, CAST({LAT} AS DOUBLE) AS lat, CAST({LON} AS DOUBLE) AS lon, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 500 / 1.0 END AS ele FROM events WHERE user_id IS NOT NULL),
l AS (SELECT user_id, t_at, concat(printf('<trkpt lat="%.7f" lon="%.7f">', lat, lon), CASE WHEN ele IS NULL THEN '' ELSE concat('<ele>', printf('%.2f', CAST(ele AS DOUBLE)), '</ele>') END, '<time>', strftime(make_timestamp(t_at * 1000000), '%Y-%m-%dT%H:%M:%SZ'), '</time></trkpt>') AS line FROM f)
SELECT CAST(user_id AS VARCHAR) AS document, sha256(concat('{documents.GPX_HEADER}', string_agg(line, '' ORDER BY t_at, line), '{documents.GPX_FOOTER}')) AS sha256 FROM l GROUP BY user_id""")
def track_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a GPX document, written by the committing sink and read again."""
    e = table(spark, d, "events").where("user_id is not null")
    ele = F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 500).cast("double"))
    points = e.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.expr(f"double({LAT})").alias("lat"), F.expr(f"double({LON})").alias("lon"), ele.alias("ele"))
    folder = kept_path(spark, "tracks")
    documents.write_tracks(points, folder, key="user_id")
    return documents.read_documents(spark, folder).select("document", F.sha2("text", 256).alias("sha256"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'view' AS o FROM events WHERE user_id IS NOT NULL AND event_type IN ('view', 'click')),
s AS (SELECT *, sum(CASE WHEN o THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM e)
SELECT a.user_id, a.event_id AS start, min(b.event_id) AS "end" FROM s a JOIN s b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.s = a.s - 1 AND NOT b.o WHERE a.o GROUP BY ALL""")
def nested_views(spark: SparkSession, d: str) -> DataFrame:
    """Views of each user that a click ends, the newest first."""
    e = table(spark, d, "events").where("event_type IN ('view', 'click')")
    return nested_intervals(e.withColumn("opens", F.col("event_type") == "view"), "user_id", "event_id", "opens").select("user_id", "start", "end")
