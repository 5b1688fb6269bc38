"""Pairs of small pages are compared directly, those of large pages in the grid; totals come from counts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalog.reports import _consistency
from pageloom.functions.geometry import intersection
from pageloom.operators import greedy as G
from pageloom.operators import reports as R
from pageloom.operators.joins import candidate_pairs
from pageloom.skew import profile_keys


def _boxes(spark):
    rng = random.Random(3)
    rows = []
    for page, n in ((1, 4), (2, 60), (3, 9), (None, 5)):
        for pos in range(n):
            x, y = rng.randrange(-300, 600), rng.randrange(-300, 600)
            flat = pos % 7 == 0
            rows.append((page, len(rows), pos, x, y, x if flat else x + rng.randrange(-20, 400), y + rng.randrange(200)))
    rows.append((1, len(rows), 99, None, 0, 5, 5))
    return spark.createDataFrame(rows, "page_id long, region_id long, pos long, x1 int, y1 int, x2 int, y2 int")


@pytest.mark.parametrize("limit", [0, 20, 1_000])
@pytest.mark.parametrize("rule", [None, lambda a, b: intersection(a, b) > 0])
def test_direct_pairs_are_those_of_the_grid(spark, limit, rule):
    boxes = _boxes(spark)
    ids = lambda pairs: sorted(pairs.select(
        F.col("a.page_id").alias("p"), F.col("a.region_id").alias("a"), F.col("b.region_id").alias("b")).collect())
    want = ids(candidate_pairs(boxes, rule))
    assert len(want) > 50
    assert ids(candidate_pairs(boxes, rule, direct=profile_keys(boxes, ["page_id"], limit))) == want


def test_regions_lie_by_page(tables):
    """Small pages meet without a further shuffle: only lines, documents and ranked rows are dealt out."""
    pairs = candidate_pairs(tables.regions, direct=tables.direct_profile)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(page_id" in plan and "_cx" not in plan
    last = plan[:plan.index("Window [row_number")]
    assert "Exchange" not in last


def test_consistency_totals(spark, tables):
    rows = [(None, 0.5, False), (None, 0.5, False), (None, 0.9, True), (None, 1.0, True), ("no_box", None, None), ("too_small", None, None)]
    joined = spark.createDataFrame(rows, "skip string, similarity double, match boolean")
    got = R.consistency_summary(joined).first()
    assert (got.total, got.matched, got.mismatch, got.skipped_no_box, got.skipped_empty_text, got.skipped_too_small) == (4, 2, 2, 1, 0, 1)
    assert (got.avg_similarity, got.min_similarity, got.max_similarity) == (pytest.approx(0.725), 0.5, 1.0)
    assert got.median_similarity == pytest.approx(0.7)
    empty = R.consistency_summary(joined.where("false")).first()
    assert (empty.total, empty.avg_similarity, empty.median_similarity) == (0, 0.0, 0.0)
    # readings are compared where they lie: the two sides are not shuffled by region
    plan = _consistency(tables)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(region_id" not in plan


def test_pair_rules_leave_whole_stage_code(spark):
    """The projection of padded boxes made one method too long to be compiled."""
    rows = [(1, i, i, i * 3, i * 5, i * 3 + 40, i * 5 + 30, t) for i, t in enumerate(["abc", "가나", "漢字", "a漢", "", None, "12"])]
    regions = spark.createDataFrame(
        rows, "page_id long, region_id long, pos long, x1 int, y1 int, x2 int, y2 int, source_text string")
    grouped = regions.withColumns({"is_sfx": F.lit(False), "container_id": F.lit(None).cast("long")})
    for edges in (G.cluster_edges(regions), G.duplicate_edges(regions), G.group_edges(grouped)):
        plan = edges._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction" in plan
    pairs = {(r.a, r.b) for r in G.duplicate_edges(regions).collect()}
    assert (0, 1) in pairs and all(a not in (4, 5) and b not in (4, 5) for a, b in pairs)
