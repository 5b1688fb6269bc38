"""Keyed state over event streams.

Each processor is used with ``groupBy(key).transformWithStateInPandas``; the
functions at the end wire them up.  State per key is bounded: counters, a set
of finished tasks of one chapter run, or the newest n events.  The state store
must be RocksDB (``pageloom.session.SETTINGS``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FINAL = ("complete", "failed")


def _in_order(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts, ignore_index=True).sort_values(list(order), kind="stable")


class ChapterProgress(StatefulProcessor):
    """Counts each finished task of a chapter run once; a start resets the run."""

    schema = "chapter_id long, completed long, failed long, percent long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.finals = handle.getMapState("finals", "task_id string", "failed boolean")
        self.run = handle.getValueState("run", "completed long, failed long, total long, done boolean")

    def handleInputRows(self, key, rows, timerValues):
        completed, failed, total, done = self.run.get() if self.run.exists() else (0, 0, 0, False)
        for r in _in_order(rows, "ts", "event_id").itertuples(index=False):
            if r.type == "chapter_start":
                self.finals.clear()
                completed, failed, done = 0, 0, False
                total = 0 if pd.isna(r.total_pages) else int(r.total_pages)
            elif r.type == "chapter_complete":
                done = True
            elif not done and r.task_id is not None and r.stage in FINAL:
                if not self.finals.containsKey((r.task_id,)):
                    bad = r.stage == "failed"
                    self.finals.updateValue((r.task_id,), (bad,))
                    completed, failed = completed + 1, failed + int(bad)
        self.run.update((completed, failed, total, done))
        share = min(99, int(completed / total * 100 + 0.5)) if total > 0 else 0
        yield pd.DataFrame({
            "chapter_id": [key[0]], "completed": [completed], "failed": [failed], "percent": [100 if done else share],
        })

    def close(self) -> None:
        pass


class NewestEvents(StatefulProcessor):
    """A bounded buffer per listener: the newest n events stay."""

    schema = "listener string, event_ids string, dropped long"

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", "event_id long")
        self.lost = handle.getValueState("lost", "n long")

    def handleInputRows(self, key, rows, timerValues):
        held = [r[0] for r in self.buffer.get()]
        held += [int(i) for i in _in_order(rows, "ts", "event_id")["event_id"]]
        lost = (self.lost.get()[0] if self.lost.exists() else 0) + max(0, len(held) - self.n)
        held = held[-self.n:]
        self.buffer.put([(i,) for i in held])
        self.lost.update((lost,))
        yield pd.DataFrame({"listener": [key[0]], "event_ids": [",".join(map(str, held))], "dropped": [lost]})

    def close(self) -> None:
        pass


class TaskStore(StatefulProcessor):
    """Last state per task; forgotten ``ttl_ms`` after its last event (event time)."""

    schema = "task_id string, stage string, ts timestamp, expired boolean"

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "stage string, ts_ms long")

    def handleInputRows(self, key, rows, timerValues):
        newest = _in_order(rows, "ts", "event_id").iloc[-1]
        at = int(newest["ts"].timestamp() * 1000)
        if self.last.exists() and self.last.get()[1] > at:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((newest["stage"], at))
        self.handle.registerTimer(at + self.ttl_ms)
        yield pd.DataFrame({"task_id": [key[0]], "stage": [newest["stage"]], "ts": [newest["ts"]], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists():
            stage, at = self.last.get()
            self.last.clear()
            yield pd.DataFrame({"task_id": [key[0]], "stage": [stage], "ts": [pd.Timestamp(at, unit="ms")], "expired": [True]})

    def close(self) -> None:
        pass


class Admission(StatefulProcessor):
    """Labels starts of a queue: accepted, duplicate (still running) or over_limit."""

    schema = "queue string, event_id long, chapter_id long, label string"

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getMapState("running", "chapter_id long", "since long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        out, n = [], (self.count.get()[0] if self.count.exists() else 0)
        for r in _in_order(rows, "ts", "event_id").itertuples(index=False):
            job = (int(r.chapter_id),)
            active = self.running.containsKey(job)
            if r.action == "start":
                label = "duplicate" if active else "over_limit" if n >= self.limit else "accepted"
                if label == "accepted":
                    self.running.updateValue(job, (int(r.event_id),))
                    n += 1
                out.append((key[0], int(r.event_id), job[0], label))
            elif active:
                self.running.removeKey(job)
                n -= 1
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["queue", "event_id", "chapter_id", "label"])

    def close(self) -> None:
        pass


class ProbeBan(StatefulProcessor):
    """Bans a host at its ``retries``-th bad request within the look-back; times are microseconds."""

    schema = "host string, banned_at timestamp, banned_until timestamp"

    def __init__(self, retries: int = 8, find_ms: int = 600_000, ban_ms: int = 86_400_000):
        self.retries, self.find, self.ban = retries, find_ms * 1000, ban_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at long")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows, timerValues):
        recent = [r[0] for r in self.recent.get()]
        until = self.until.get()[0] if self.until.exists() else None
        out = []
        for ts in _in_order(rows, "ts")["ts"]:
            at = round(ts.timestamp() * 1_000_000)
            if until is not None and at < until:
                continue
            recent = [x for x in recent if x >= at - self.find][-(self.retries - 1):] + [at]
            if len(recent) >= self.retries:
                until, recent = at + self.ban, []
                out.append((key[0], ts, pd.Timestamp(until, unit="us")))
        if recent:
            self.recent.put([(x,) for x in recent])
        else:
            self.recent.clear()
        if until is not None:
            self.until.update((until,))
        yield pd.DataFrame(out, columns=["host", "banned_at", "banned_until"])

    def close(self) -> None:
        pass


class Carryover(StatefulProcessor):
    """Texts carried to the next page: put once, taken once, dropped after a while."""

    schema = "pair_id string, region_id long, carried_text string"

    def __init__(self, ttl_ms: int = 3_600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.text = handle.getValueState("text", "bottom_text string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for r in _in_order(rows, "ts", "event_id").itertuples(index=False):
            if r.action == "put":
                self.text.update((r.bottom_text,))
            else:
                held = self.text.get()[0] if self.text.exists() else None
                self.text.clear()
                out.append((key[0], int(r.region_id), held))
        yield pd.DataFrame(out, columns=["pair_id", "region_id", "carried_text"])

    def close(self) -> None:
        pass


class StageLatency(StatefulProcessor):
    """Milliseconds between consecutive events of a task."""

    schema = "task_id string, event_id long, from_stage string, stage string, latency_ms double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "stage string, at_us long")

    def handleInputRows(self, key, rows, timerValues):
        stage, at = self.last.get() if self.last.exists() else (None, None)
        out = []
        for r in _in_order(rows, "ts", "event_id").itertuples(index=False):
            now = r.ts.value // 1000
            out.append((key[0], int(r.event_id), stage, r.stage, None if at is None else (now - at) / 1000))
            stage, at = r.stage, now
        self.last.update((stage, at))
        yield pd.DataFrame(out, columns=["task_id", "event_id", "from_stage", "stage", "latency_ms"])

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, key: str, processor: StatefulProcessor, time_mode: str = "none", mode: str = "update") -> DataFrame:
    """Run a processor per key."""
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.schema, outputMode=mode, timeMode=time_mode
    )


def chapter_progress(stream: DataFrame) -> DataFrame:
    return keyed(stream, "chapter_id", ChapterProgress())


def newest_events(stream: DataFrame, n: int) -> DataFrame:
    return keyed(stream, "listener", NewestEvents(n))


def task_store(stream: DataFrame, ttl_ms: int, delay: str = "10 minutes") -> DataFrame:
    return keyed(stream.withWatermark("ts", delay), "task_id", TaskStore(ttl_ms), "eventTime")


def admission_audit(stream: DataFrame, limit: int) -> DataFrame:
    return keyed(stream, "queue", Admission(limit))


def probe_ban(hits: DataFrame, retries: int = 8, find_ms: int = 600_000, ban_ms: int = 86_400_000) -> DataFrame:
    return keyed(hits, "host", ProbeBan(retries, find_ms, ban_ms))


def carryover(stream: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    return keyed(stream, "pair_id", Carryover(ttl_ms), "processingTime")


def stage_latency(stream: DataFrame) -> DataFrame:
    return keyed(stream, "task_id", StageLatency())
