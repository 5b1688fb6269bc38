"""Pointer doubling, and what is built on it, against following the rows one by one."""

import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from pageloom.operators import greedy as G
from pageloom.operators import streams as E
from pageloom.operators.chains import chain_ranks
from pageloom.skew import profile_keys


def test_chain_ranks(spark):
    rnd = random.Random(1)
    edges = {i: rnd.randrange(i + 1, i + 9) for i in range(300)}
    starts = [0, 7, 290, 999]
    got = sorted((r.node, r["rank"]) for r in chain_ranks(
        spark.createDataFrame([(a, b, 1) for a, b in edges.items()], "node long, next long, steps int"),
        spark.createDataFrame([(s,) for s in starts], "node long"),
    ).collect())
    want = []
    for node in starts:
        rank = 0
        while node is not None:
            want.append((node, rank))
            node, rank = edges.get(node), rank + 1
    assert got == sorted(want)


def items_of(spark, pages):
    rows = [(p, p * 10**6 + i, i // 2, t, c) for p, texts in pages.items() for i, (t, c) in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id long, region_id long, pos int, text string, context string")


@pytest.mark.parametrize("max_items, max_chars, piece", [(12, 300, 12), (3, 0, 5), (0, 60, 1), (200, 900, 150), (0, 0, 5), (1, 1, 4), (9, 40, 37)])
def test_pieces_pack_as_one_call(spark, max_items, max_chars, piece):
    """Ties in the order, empty and null texts, entries above the limit, pages that end at a piece."""
    rnd = random.Random(max_items + max_chars)
    word = lambda: rnd.choice(("", None, "a", "word", "x" * 30, "y" * 400))
    pages = {p: [(word(), rnd.choice((None, "", "ctx"))) for _ in range(n)] for p, n in enumerate((1, 24, 25, 150, 151, 400, 1000), 1)}
    items = items_of(spark, pages)
    cold, hot = profile_keys(items, ["page_id"], 10_000), profile_keys(items, ["page_id"], 23)
    assert cold.hot_count == 0 and hot.hot_count == 6
    got, want = (
        sorted(map(tuple, G.pack_by_chars(items, max_items, max_chars, profile=p, piece_rows=piece).select("region_id", "batch_no", "item_no").collect()))
        for p in (hot, cold)
    )
    assert got == want and len(got) == sum(map(len, pages.values()))


def test_one_huge_page(spark):
    """400,000 rows of one page in pieces of 20,000, against one sequential run."""
    n = 400_000
    df = spark.range(n).select(
        F.lit(1).cast("long").alias("page_id"), F.col("id").alias("region_id"), F.col("id").alias("pos"),
        F.repeat(F.lit("x"), (F.xxhash64("id") % 40 + 40).cast("int")).alias("text"), F.lit(None).cast("string").alias("context"),
    )
    out = G.pack_by_chars(df, 12, 300, profile=profile_keys(df, ["page_id"], 50_000), piece_rows=20_000)
    item = namedtuple("Item", "item_id size")
    sizes = df.orderBy("pos").select(F.length("text") + 3).toPandas().iloc[:, 0]
    want = G._packer(12, 300)([item(i, int(s)) for i, s in enumerate(sizes)])
    rows = out.select("region_id", "batch_no", "item_no").orderBy("region_id").toPandas()
    assert len(rows) == n and want == list(rows.itertuples(index=False, name=None))


def bans_of(times, retries, find, ban):
    """One hit after the other."""
    out, recent, until = [], [], None
    for at in sorted(times):
        if until is not None and at < until:
            continue
        recent = [x for x in recent if x >= at - find] + [at]
        if len(recent) >= retries:
            until, recent = at + ban, []
            out.append(at)
    return out


@pytest.mark.parametrize("retries, find, ban", [(1, 10, 30), (3, 20, 50), (4, 100, 7), (8, 600, 86400), (2, 0, 5)])
def test_every_ban(spark, retries, find, ban):
    """Also with many hits at one instant, and a host that holds most of the rows in pieces."""
    rnd = random.Random(retries)
    hits = {f"h{h}": [rnd.randrange(3000) for _ in range(n)] for h, n in enumerate((0, 1, 40, 300, 1500))}
    hits["same"] = [5] * 30 + [100] * 3
    rows = [(h, t) for h, ts in hits.items() for t in ts] + [(None, 5)] * 9 + [("null", None)] * 9
    df = spark.createDataFrame(rows, "host string, at long").withColumn("ts", F.timestamp_seconds("at"))
    want = sorted((h, i, t) for h, ts in hits.items() for i, t in enumerate(bans_of(ts, retries, find, ban), 1))
    hot = profile_keys(df.where("host IS NOT NULL"), ["host"], 100)
    assert hot.hot_count == 2
    for profile in (None, hot):
        out = E.probe_bans(df, retries, find, ban, profile)
        got = sorted((r.host, r.ban_no, r.s) for r in out.withColumn("s", F.unix_seconds("banned_at")).collect())
        assert got == want and (want or retries == 8)
    assert E.probe_bans(df.where("1 = 0"), retries, find, ban).count() == 0
    first = {r.host: r.s for r in E.probe_ban(df.where("host <> 'null'"), retries, find, ban).withColumn("s", F.unix_seconds("banned_at")).collect()} if find else None
    assert first is None or first == {h: s for h, i, s in want if i == 1}
