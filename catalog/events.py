"""Event-stream queries in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from pageloom.operators import streams as E


def runs(t):
    """Progress events with a start and an end per chapter now and then."""
    kind = F.when(F.col("event_id") % 97 == 0, "chapter_start").when(F.col("event_id") % 1009 == 1008, "chapter_complete").otherwise("progress")
    return t.progress.select("event_id", "ts", "chapter_id", "task_id", "stage", kind.alias("type"), F.lit(None).cast("string").alias("status"))


@query("chapter_progress", """, e AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'chapter_start' WHEN event_id % 1009 = 1008 THEN 'chapter_complete' ELSE 'progress' END AS type FROM progress),
 m AS (SELECT chapter_id, max(ts) FILTER (type = 'chapter_start') AS s, max(ts) FILTER (type = 'chapter_complete') AS f FROM e GROUP BY 1),
 d AS (SELECT chapter_id, task_id, arg_min(stage, ts) AS stage FROM e JOIN m USING (chapter_id) WHERE type = 'progress' AND stage IN ('complete', 'failed') AND (s IS NULL OR ts > s) GROUP BY 1, 2),
 c AS (SELECT chapter_id, count(*) AS completed, count(*) FILTER (stage = 'failed') AS failed FROM d GROUP BY 1)
 SELECT chapter_id, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed,
   CAST(CASE WHEN f IS NOT NULL AND (s IS NULL OR f > s) THEN 100 ELSE least(99, floor(coalesce(completed, 0)/(chapter_id + 20)*100 + 0.5)) END AS BIGINT) AS percent FROM m LEFT JOIN c USING (chapter_id)""", ("progress",))
def _(t):
    totals = t.progress.select("chapter_id").distinct().withColumn("total_pages", F.col("chapter_id") + 20)
    return E.chapter_progress(runs(t), totals)


@query("task_store", """, l AS (SELECT task_id, arg_max(stage, ts) AS stage, max(ts) AS ts FROM progress GROUP BY 1)
 SELECT task_id, stage FROM (SELECT * FROM l WHERE ts >= (SELECT max(ts) FROM progress) - INTERVAL 36 HOUR ORDER BY ts DESC, task_id DESC LIMIT 100)""", ("progress",))
def _(t):
    now = t.progress.agg(F.max("ts")).scalar()
    last = E.task_store(t.progress, now, 36 * 3600, 100, ["stage"])
    return last.select("task_id", "stage")


@query("duplicate_starts", """, j AS (SELECT event_id, chapter_id, ts, CASE WHEN stage IN ('complete', 'failed') THEN 'finish' ELSE 'start' END AS action FROM progress),
 l AS (SELECT *, lag(action) OVER (PARTITION BY chapter_id ORDER BY ts, event_id) AS p FROM j)
 SELECT event_id, chapter_id, CASE WHEN p = 'start' THEN 'duplicate' ELSE 'accepted' END AS label FROM l WHERE action = 'start'""", ("progress",))
def _(t):
    action = F.when(F.col("stage").isin("complete", "failed"), "finish").otherwise("start")
    jobs = t.progress.select("event_id", "chapter_id", "ts", action.alias("action"))
    return E.duplicate_starts(jobs, profile=t.profile("jobs", jobs, ["chapter_id"])).select("event_id", "chapter_id", "label")


def requests(t):
    """Events as access-log requests: refused ones look for bad paths."""
    e = F.col("event_type")
    path = F.when(e == "error", "/.env.local").when(e == "view", "/wp-admin/setup.php?x=1").otherwise("/index.html")
    code = F.when(e == "error", 404).when(e == "view", 403).otherwise(200)
    host = F.when(F.col("user_id") % 25 == 0, "127.0.0.1").otherwise(F.concat(F.lit("10.0.0."), (F.col("user_id") % 40).cast("string")))
    return t.events.select("event_id", "ts", host.alias("host"), path.alias("path"), code.alias("code"))


@query("probe_ban", """WITH h AS (SELECT ts, '10.0.0.' || (user_id % 40) AS host FROM events WHERE event_type IN ('error', 'view') AND user_id % 25 <> 0),
 c AS (SELECT host, ts, count(*) OVER (PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL 36000 SECOND PRECEDING AND CURRENT ROW) AS hits FROM h)
 SELECT host, epoch_us(min(ts)) AS banned_at FROM c WHERE hits >= 4 GROUP BY host""")
def _(t):
    """A longer look-back than the default, as the events are sparse."""
    out = E.probe_ban(E.probe_hits(requests(t)), 4, 36000)
    return out.select("host", F.unix_micros("banned_at").alias("banned_at"))


@query("probe_bans", """WITH RECURSIVE h AS (SELECT epoch_us(ts) AS s, '10.0.0.' || (user_id % 40) AS host FROM events WHERE event_type IN ('error', 'view') AND user_id % 25 <> 0),
 f AS (SELECT host, s, lag(s, 3) OVER (PARTITION BY host ORDER BY s) AS since FROM h),
 g AS (SELECT host, s AS hit, max(since) AS since FROM f WHERE since >= s - 36000000000 GROUP BY 1, 2),
 b AS (SELECT host, min(hit) AS hit, 1::BIGINT AS ban_no FROM g GROUP BY 1
   UNION ALL SELECT b.host, min(g.hit), b.ban_no + 1 FROM b JOIN g ON g.host = b.host AND g.since >= b.hit + 3600000000 GROUP BY b.host, b.ban_no)
 SELECT host, ban_no, hit AS banned_at, hit + 3600000000 AS banned_until FROM b""")
def _(t):
    """Bans of an hour with a longer look-back than the default, so that a host has many."""
    out = E.probe_bans(E.probe_hits(requests(t)), 4, 36000, 3600)
    return out.select("host", "ban_no", F.unix_micros("banned_at").alias("banned_at"), F.unix_micros("banned_until").alias("banned_until"))


@query("stage_latency", """SELECT event_id, task_id, lag(stage) OVER w AS from_stage, stage, (epoch_us(ts) - epoch_us(lag(ts) OVER w))/1000 AS latency_ms FROM progress WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)""", ("progress",))
def _(t):
    profile = t.profile("tasks", t.progress, ["task_id"])
    return E.stage_latency(t.progress, profile).select("event_id", "task_id", "from_stage", "stage", "latency_ms")


@query("events_windowed", """SELECT CAST(epoch_us(time_bucket(INTERVAL '1 hour', ts))//1000000 AS BIGINT) AS window_start, stage, count(*) AS events, round(sum(value), 4) AS value FROM progress GROUP BY 1, 2""", ("progress",))
def _(t):
    out = E.events_windowed(t.progress, "1 hour")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "stage", "events", F.round("value", 4).alias("value"))


@query("with_task_meta", """SELECT event_id, task_id, c_mktsegment AS segment FROM progress LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = task_id""", ("progress",))
def _(t):
    meta = t.customer.select(F.col("c_custkey").cast("string").alias("task_id"), F.col("c_mktsegment").alias("segment"))
    return E.with_task_meta(t.progress, meta).select("event_id", "task_id", "segment")
