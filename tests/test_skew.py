"""The route for hot groups gives the same rows as the plain one."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import greedy as G
from pageloom.operators.graph import connected_components, first_come_set
from pageloom.skew import (
    following, max_before, ordered, previous, profile_keys, rank, running_max, running_sum,
)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def regions(tables):
    return tables.regions.where("page_id < 12").withColumns({
        "is_sfx": F.col("source_text").isin("BOOM!", "쾅!"), "container_id": F.when(F.col("pos") % 3 == 0, F.col("pos") % 2),
    }).cache()


@pytest.fixture(scope="module")
def profiles(regions):
    """(no page is hot, most pages are hot)"""
    cold, hot = profile_keys(regions, ["page_id"], 10_000), profile_keys(regions, ["page_id"], 32)
    assert cold.hot_count == 0 and 0 < hot.hot_count < 12
    return cold, hot


def test_ordered_scans(regions, profiles):
    scans = {
        "r": rank(), "p": previous(F.col("x1")), "n": following(F.col("source_text")), "m": max_before(F.col("y2")),
        "t": running_max(F.col("x2")), "s": running_sum(F.col("pos")),
    }
    out = [rows_of(ordered(regions, ["page_id"], ["y1", "x1", "pos"], scans, p).select("region_id", *scans)) for p in profiles]
    assert out[0] == out[1]


def test_one_group_in_many_pieces(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id"), (F.col("id") * 7919 % 1009).alias("v"))
    hot = profile_keys(df, ["k"], 100)
    assert hot.hot_count == 1 and hot.pieces() == 10
    scans = {"r": rank(), "p": previous(F.col("v")), "n": following(F.col("v")), "m": max_before(F.col("v")), "s": running_sum(F.col("v"))}
    got = rows_of(ordered(df, ["k"], ["id"], scans, hot).select("id", *scans))
    vs = [i * 7919 % 1009 for i in range(1000)]
    want = [
        (i, i + 1, vs[i - 1] if i else None, vs[i + 1] if i < 999 else None, max(vs[:i]) if i else None, sum(vs[: i + 1]))
        for i in range(1000)
    ]
    assert got == want


@pytest.mark.parametrize("make", [
    lambda r, p: G.drop_contained(r, 0.2, p).select("region_id"),
    lambda r, p: G.nms(r, 0.1, p).select("region_id"),
    lambda r, p: G.dedup_same_text(r.withColumn("source_text", F.substring("source_text", 1, 1)), 0.01, p).select("region_id"),
    lambda r, p: G.ocr_clusters(r, profile=p).select("region_id", "component"),
    lambda r, p: G.group_adjacent(r, profile=p).select("region_id", "group_id"),
    lambda r, p: G.merge_lines_geometric(r, profile=p).select("page_id", "line_id", "source_text"),
], ids=["drop_contained", "nms", "dedup_same_text", "ocr_clusters", "group_adjacent", "merge_lines"])
def test_hot_pages(regions, profiles, make):
    assert rows_of(make(regions, profiles[0])) == rows_of(make(regions, profiles[1]))


def test_equal_boxes_on_a_hot_page(spark):
    """Copies of a few boxes are reduced to distinct boxes before pairs are formed."""
    rnd = random.Random(5)
    boxes = [(x, y, x + 40, y + 20) for x, y in ((rnd.randrange(60), rnd.randrange(40)) for _ in range(12))]
    rows = [(1, i, i, *rnd.choice(boxes), "t" * rnd.randrange(1, 9), rnd.randrange(10) / 10) for i in range(1, 161)]
    df = spark.createDataFrame(rows, "page_id long, region_id long, pos long, x1 int, y1 int, x2 int, y2 int, source_text string, confidence double")
    cold, hot = profile_keys(df, ["page_id"], 10_000), profile_keys(df, ["page_id"], 20)
    for make in (lambda p: G.drop_contained(df, 0.5, p), lambda p: G.nms(df, 0.3, p)):
        assert rows_of(make(cold).select("region_id")) == rows_of(make(hot).select("region_id"))


def brute_components(edges):
    group = {n: {n} for e in edges for n in e}
    for a, b in edges:
        if group[a] is not group[b]:
            merged = group[a] | group[b]
            for n in merged:
                group[n] = merged
    return sorted((n, min(g)) for n, g in group.items())


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    edges = [e for e in edges if e[0] != e[1]]
    got = rows_of(connected_components(spark.createDataFrame(edges, "a long, b long")))
    assert got == brute_components(edges)


def test_first_come_set(spark):
    rnd = random.Random(4)
    edges = sorted({tuple(sorted(rnd.sample(range(120), 2))) for _ in range(260)})
    got = rows_of(first_come_set(spark.createDataFrame(edges, "winner long, loser long")))
    kept, want = set(), []
    for n in sorted(set(itertools.chain(*edges))):
        ok = not any(w in kept for w, l in edges if l == n)
        kept |= {n} if ok else set()
        want.append((n, ok))
    assert got == want
