"""Joins inside pages: rows that lie by page stay where they are, and the rows are those of a plain join."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import catalog
from pageloom.plans.views import Tables
from pageloom.skew import ROWS_COMPARED, KeyProfile, profile_keys


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_join_is_that_of_all_columns(spark, how):
    left = spark.createDataFrame(
        [(p, r, f"{p}-{r}") for p in (1, 2, 3, None) for r in (1, 2, 2, 3, None)], "page_id long, region_id long, text string")
    right = spark.createDataFrame(
        [(1, 1, 10), (1, 2, 20), (1, 2, 21), (2, 3, 30), (2, None, 40), (None, 1, 50), (9, 1, 60)], "page_id long, region_id long, found int")
    profile = profile_keys(left, ["page_id"])
    assert profile.largest == 5
    small, plain = profile.join(left, right, ["region_id"], how), left.join(right, ["page_id", "region_id"], how)
    assert small.columns == plain.columns
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(small) == rows(plain)
    for other in (KeyProfile(("page_id",)), KeyProfile(("page_id",), largest=ROWS_COMPARED + 1)):
        assert rows(other.join(left, right, ["region_id"], how)) == rows(plain)


@pytest.mark.parametrize("name", ["group_edges", "dedup_same_text", "merge_lines_geometric", "fill_without_request"])
def test_regions_are_dealt_out_by_page_only(spark, name):
    """No exchange of a plan deals rows out by page and another column."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert re.search(r"hashpartitioning\(page_id#\d+L?, \d+\)", plan)
    assert not re.search(r"hashpartitioning\(page_id#\d+L?, [a-z]", plan)


@pytest.mark.parametrize("negative", [False, True])
def test_beginnings_of_texts_are_enough(spark, tmp_path, negative):
    """Texts of regions, whatever the line numbers and suppliers, are those cut from whole texts."""
    lines = [(o, n, (o * 31 + n * 7) % 97, (o * 13 + n) % 50 - (25 if negative else 0), float(n), float(o)) for o in range(40) for n in (1, 4, 7, 30)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    texts = [(d, "".join(chr(97 + (d + i) % 26) for i in range(d * 9))) for d in range(30) if d != 11]
    spark.createDataFrame([*texts, (11, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.page_id, r.pos): r.source_text for r in Tables(spark, str(tmp_path)).regions.collect()}
    whole = dict(texts)
    ranks: dict = {}
    want = {}
    fixed = ["BOOM!", "NEWTOKI 95", "12 34", "쾅!", "A1_$", "안녕 하세요", "...", "site.com"]
    cut = spark.createDataFrame(
        [(o, n, whole.get(p % 30), s) for o, n, p, s, _, _ in lines], "o long, n int, text string, s long").select(
        "o", "n", F.expr("substring(text, int(1 + s % 20), int(4 + n * 3))").alias("t"))
    cut = {(r.o, r.n): r.t for r in cut.collect()}
    for o, n, p, s, _, _ in sorted(lines):
        ranks[o // 8] = pos = ranks.get(o // 8, 0) + 1
        want[o // 8, pos] = fixed[p % 23] if p % 23 < 8 else cut[o, n]
    assert got == want
