"""Batch forms of the event-stream operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom import constants as K
from pageloom.operators.chains import chain_ranks
from pageloom.skew import KeyProfile, checkpoint, ordered, previous, running_max

FINAL_STAGES = ("complete", "failed")


def is_final(stage: Column, status: Column | None = None) -> Column:
    out = stage.isin(*FINAL_STAGES)
    return out if status is None else out | F.coalesce(status.isin("completed", "failed"), F.lit(False))


def chapter_progress(events: DataFrame, totals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Progress of each chapter after all events.

    ``events``: keys, type (chapter_start, progress, chapter_complete), task_id,
    stage, status, ts.  Only events after the last start count; a task counts
    once, with its first final event.  The percentage stays below 100 until the
    chapter itself is complete.  ``totals``: keys, total_pages.
    """
    keys = keys or ["chapter_id"]
    marks = events.groupBy(*keys).agg(
        F.max(F.when(F.col("type") == "chapter_start", F.col("ts"))).alias("_start"),
        F.max(F.when(F.col("type") == "chapter_complete", F.col("ts"))).alias("_end"),
    )
    after = F.col("_start").isNull() | (F.col("ts") > F.col("_start"))
    finals = events.where((F.col("type") == "progress") & F.col("task_id").isNotNull()).where(
        is_final(F.col("stage"), F.col("status"))
    )
    bad = (F.col("stage") == "failed") | F.coalesce(F.col("status") == "failed", F.lit(False))
    first = finals.join(marks, keys).where(after).groupBy(*keys, "task_id").agg(F.min_by(bad, "ts").alias("_bad"))
    counts = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("completed"), F.count_if("_bad").alias("failed"))
    j = marks.join(counts, keys, "left").join(totals, keys, "left")
    done = F.coalesce("completed", F.lit(0).cast("long"))
    complete = F.col("_end").isNotNull() & (F.col("_start").isNull() | (F.col("_end") > F.col("_start")))
    share = F.when(F.col("total_pages") > 0, F.least(F.lit(99), F.floor(done / F.col("total_pages") * 100 + 0.5))).otherwise(F.lit(0))
    return j.select(
        *keys, done.alias("completed"), F.coalesce("failed", F.lit(0).cast("long")).alias("failed"),
        F.when(complete, F.lit(100)).otherwise(share).cast("long").alias("percent"),
    )


def task_store(events: DataFrame, now: Column, ttl_seconds: int, max_tasks: int, columns: list[str]) -> DataFrame:
    """Last state per task, without expired ones, the newest ``max_tasks`` only."""
    last = events.groupBy("task_id").agg(F.max_by(F.struct("ts", *columns), F.struct("ts", "event_id")).alias("_l")).select("task_id", "_l.*")
    alive = last.where(F.timestamp_diff("MICROSECOND", F.col("ts"), now) <= ttl_seconds * 1_000_000)
    return alive.orderBy(F.desc("ts"), F.desc("task_id")).limit(max_tasks)


def duplicate_starts(jobs: DataFrame, key: str = "chapter_id", profile: KeyProfile | None = None) -> DataFrame:
    """Start events of a key that is still running (its last event is a start)."""
    seen = ordered(jobs, [key], ["ts", "event_id"], {"_last": previous(F.col("action"))}, profile)
    label = F.when(F.coalesce(F.col("_last") == "start", F.lit(False)), "duplicate").otherwise("accepted")
    return seen.where(F.col("action") == "start").withColumn("label", label).drop("_last")


def probe_hits(requests: DataFrame) -> DataFrame:
    """Requests for well-known bad paths that were refused; local ones are ignored."""
    local = F.col("host").rlike(r"^127\.") | (F.col("host") == "::1")
    return requests.where(F.col("path").rlike(K.PROBE_PATH) & F.col("code").isin(401, 403, 404) & ~local)


def probe_ban(hits: DataFrame, max_retry: int = 8, find_seconds: int = 600, ban_seconds: int = 86400) -> DataFrame:
    """First ban per host: ``max_retry`` hits within ``find_seconds``.

    Hits of the same instant are counted first.  A host is then cut into time
    buckets as long as the look-back; each bucket also sees the one before it,
    so a busy host is spread over its buckets.
    """
    counted = hits.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp"))).groupBy("host", "_s").agg(
        F.count(F.lit(1)).alias("_m")
    )
    span = find_seconds * 1_000_000
    own = F.floor(F.col("_s") / span)
    spread = counted.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy("host", "_bucket").orderBy("_s").rangeBetween(-span, 0)
    over = spread.withColumn("_hits", F.sum("_m").over(w)).where("_bucket = _own").where(F.col("_hits") >= max_retry)
    first = over.groupBy("host").agg(F.min("_s").alias("_at"))
    return first.select(
        "host", F.timestamp_micros("_at").alias("banned_at"),
        F.timestamp_micros(F.col("_at") + ban_seconds * 1_000_000).alias("banned_until"),
    )


def probe_bans(
    hits: DataFrame, max_retry: int = 8, find_seconds: int = 600, ban_seconds: int = 86400, profile: KeyProfile | None = None,
) -> DataFrame:
    """Every ban of a host, numbered from 1, as a stream of its hits would give them.

    While a ban lasts hits are ignored, and the count starts anew at its end.  An
    instant is a trigger when the ``max_retry`` hits up to it lie within
    ``find_seconds``; after a ban that ends at t, the next one is the first
    trigger whose hits all came at t or later.  So every trigger points
    to one later trigger (one ordered scan), and the bans are the chain of
    pointers from a host's first trigger.

    Hits of one instant are counted first, and a host is cut into time
    buckets, so a busy host is spread; repeated hits count each, null times and
    hosts give nothing.  Of ``hits`` only host and ts are read.
    """
    if ban_seconds <= 0 or max_retry < 1:
        raise ValueError("a ban lasts, and needs a hit")
    counted = hits.where("host IS NOT NULL AND ts IS NOT NULL").groupBy(
        "host", F.unix_micros(F.col("ts").cast("timestamp")).alias("_s")
    ).agg(F.least(F.count(F.lit(1)), F.lit(max_retry)).alias("_m"))
    span, ban = find_seconds * 1_000_000, ban_seconds * 1_000_000
    own = F.floor(F.col("_s") / max(span, 1))
    copies = counted.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(own, own + 1))).withColumn(
        "_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m")))
    )
    w = Window.partitionBy("host", "_bucket").orderBy("_s", "_c")
    since = copies.withColumn("_from", F.lag("_s", max_retry - 1).over(w)).where("_bucket = _own AND _c = _m")
    triggers = checkpoint(since.where(F.col("_from") >= F.col("_s") - span).select("host", F.col("_s").alias("at"), F.col("_from").alias("t")))
    ends = triggers.select("host", "at", (F.col("at") + ban).alias("t"), F.lit(1).alias("kind"))
    both = triggers.withColumn("kind", F.lit(0)).select("host", "at", "t", "kind").unionByName(ends)
    # from the latest on: the earliest trigger among those not older than the end of this ban
    later = running_max(F.when(F.col("kind") == 0, -F.col("at")))
    seen = ordered(both, ["host"], [-F.col("t"), "kind", "at"], {"_later": later}, profile)
    links = seen.where("kind = 1 AND _later IS NOT NULL").select(
        F.struct("host", "at").alias("node"), F.struct("host", (-F.col("_later")).alias("at")).alias("next"), F.lit(1).alias("steps")
    )
    starts = triggers.groupBy("host").agg(F.min("at").alias("at")).select(F.struct("host", "at").alias("node"))
    return chain_ranks(links, starts).select(
        "node.host", (F.col("rank") + 1).alias("ban_no"), F.timestamp_micros("node.at").alias("banned_at"),
        F.timestamp_micros(F.col("node.at") + ban).alias("banned_until"),
    )


def stage_latency(events: DataFrame, profile: KeyProfile | None = None) -> DataFrame:
    """Milliseconds since the previous event of the same task."""
    seen = ordered(
        events, ["task_id"], ["ts", "event_id"], {"from_stage": previous(F.col("stage")), "_ts": previous(F.col("ts"))}, profile
    )
    ms = F.timestamp_diff("MICROSECOND", F.col("_ts"), F.col("ts")) / 1000
    return seen.withColumn("latency_ms", ms).drop("_ts")


def events_windowed(events: DataFrame, size: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Counts per time window and stage; also runs on a stream with a watermark."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy(F.window("ts", size, slide), "stage").agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")
    ).select(F.col("window.start").alias("window_start"), "stage", "events", "value")


def with_task_meta(events: DataFrame, meta: DataFrame, max_broadcast_rows: int = 200_000) -> DataFrame:
    """Events (batch or stream) with the facts known about their task.

    The table of tasks is broadcast when it is small; a larger one is joined by
    shuffling.
    """
    known = meta.dropDuplicates(["task_id"])
    small = known.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    return events.join(F.broadcast(known) if small else known, "task_id", "left")
