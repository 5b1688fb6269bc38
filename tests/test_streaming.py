"""Streams give what the batch forms give on the same events."""

import pytest
from pyspark.sql import functions as F

from catalog.events import requests, runs
from pageloom.operators import streams as E
from pageloom.streaming import stateful as S


def run_stream(spark, build, source, folder, name, mode="update"):
    """Write the events as two files, stream them one by one, return all output rows."""
    src, ckpt = str(folder / "in"), str(folder / "ckpt")
    # keep time order across the two files
    ordered = source.withColumn("_half", F.ntile(2).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts")))
    for half in (1, 2):
        ordered.where(F.col("_half") == half).drop("_half").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name)


@pytest.fixture(scope="module")
def progress(tables):
    return tables.progress.withColumn("ts", F.col("ts").cast("timestamp"))


def test_chapter_progress(spark, tables, progress, tmp_path):
    events = runs(tables).withColumns({"ts": F.col("ts").cast("timestamp"), "total_pages": F.lit(40)}).drop("status")
    totals = events.select("chapter_id").distinct().withColumn("total_pages", F.lit(40))
    want = E.chapter_progress(events.withColumn("status", F.lit(None).cast("string")), totals).select("chapter_id", "completed", "failed")
    rows = run_stream(spark, S.chapter_progress, events, tmp_path, "chapter_progress_out").collect()
    last = {r.chapter_id: (r.completed, r.failed) for r in rows}  # updates arrive in order
    final = {r.chapter_id: (r.completed, r.failed) for r in want.collect()}
    assert set(last) == set(final)
    # a chapter that was completed ignores later finals in the stream only
    open_chapters = {r.chapter_id for r in events.groupBy("chapter_id").agg(F.count_if(F.col("type") == "chapter_complete").alias("c")).where("c = 0").collect()}
    assert open_chapters and all(last[c] == final[c] for c in open_chapters)


def test_newest_events(spark, progress, tmp_path):
    events = progress.select("event_id", "ts", F.col("task_id").alias("listener"))
    rows = run_stream(spark, lambda s: S.newest_events(s, 5), events, tmp_path, "newest_out").collect()
    got = {r.listener: r.event_ids for r in rows}
    from pageloom.operators.windows import newest_per_listener
    want = newest_per_listener(events, 5, "listener", "ts", "event_id").groupBy("listener").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("a"), "event_id"))), lambda s: s["event_id"].cast("string")), ",").alias("ids")
    )
    assert got == {r.listener: r.ids for r in want.collect()}


def test_stage_latency(spark, progress, tmp_path):
    events = progress.select("event_id", "ts", "task_id", "stage")
    out = run_stream(spark, S.stage_latency, events, tmp_path, "latency_out")
    want = E.stage_latency(events).select("event_id", "from_stage", "stage", F.round("latency_ms", 3))
    got = out.select("event_id", "from_stage", "stage", F.round("latency_ms", 3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_probe_ban(spark, tables, tmp_path):
    hits = E.probe_hits(requests(tables)).select("host", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    want = {r.host: r.banned_at for r in E.probe_ban(hits, 3, 36000).collect()}
    out = run_stream(spark, lambda s: S.probe_ban(s, 3, 36_000_000), hits, tmp_path, "ban_out")
    first = {r.host: r.at for r in out.groupBy("host").agg(F.min("banned_at").alias("at")).collect()}
    assert want and first == want
    # shorter bans: every ban of every host
    want = sorted((r.host, r.banned_at, r.banned_until) for r in E.probe_bans(hits, 3, 36000, 7200).collect())
    (tmp_path / "again").mkdir()
    out = run_stream(spark, lambda s: S.probe_ban(s, 3, 36_000_000, 7_200_000), hits, tmp_path / "again", "bans_out")
    assert len(want) > len(first)
    assert sorted((r.host, r.banned_at, r.banned_until) for r in out.collect()) == want


def test_admission(spark, tmp_path):
    rows = [(1, 1, "start"), (2, 1, "start"), (3, 2, "start"), (4, 3, "start"), (5, 1, "finish"), (6, 3, "start"), (7, 1, "start")]
    df = spark.createDataFrame([("q", i, c, a) for i, c, a in rows], "queue string, event_id long, chapter_id long, action string")
    df = df.withColumn("ts", F.timestamp_seconds("event_id"))
    out = run_stream(spark, lambda s: S.admission_audit(s, 2), df, tmp_path, "admission_out")
    got = {r.event_id: r.label for r in out.collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "accepted", 4: "over_limit", 6: "accepted", 7: "over_limit"}


def test_carryover(spark, tmp_path):
    rows = [(1, "p", "put", "text", None), (2, "p", "take", None, 10), (3, "p", "take", None, 11), (4, "q", "take", None, 12)]
    df = spark.createDataFrame(rows, "event_id long, pair_id string, action string, bottom_text string, region_id long")
    df = df.withColumn("ts", F.timestamp_seconds("event_id"))
    out = run_stream(spark, S.carryover, df, tmp_path, "carry_out")
    assert {r.region_id: r.carried_text for r in out.collect()} == {10: "text", 11: None, 12: None}


def test_task_store_expires(spark, tmp_path):
    rows = [(1, "a", "ocr", 0), (2, "a", "complete", 60), (3, "b", "ocr", 100), (4, "c", "ocr", 90_000)]
    df = spark.createDataFrame(rows, "event_id long, task_id string, stage string, at long").withColumn("ts", F.timestamp_seconds("at"))
    out = run_stream(spark, lambda s: S.task_store(s, 3_600_000, "1 minute"), df, tmp_path, "store_out").collect()
    assert {r.task_id for r in out if r.expired} == {"a", "b"}
    assert {r.task_id for r in out if not r.expired} == {"a", "b", "c"}


def test_windowed_counts(spark, progress, tmp_path):
    events = progress.select("event_id", "ts", "stage", "value")
    out = run_stream(spark, lambda s: E.events_windowed(s, "1 hour", watermark="1 hour"), events, tmp_path, "window_out", "append")
    want = {(r.window_start, r.stage): r.events for r in E.events_windowed(events, "1 hour").collect()}
    rows = out.collect()
    assert len(rows) > 100 and all(want[(r.window_start, r.stage)] == r.events for r in rows)
