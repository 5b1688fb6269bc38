"""A sample of the queries against their SQL twins; tests/oracle.py runs them all."""

import oracle
import pytest

import __spark_entry__ as entry

SAMPLE = [
    "is_sfx", "noise_reason", "clean_annotations", "split_by_punctuation", "infer_id", "parse_catalog_url",
    "box_overlap", "candidate_pairs", "assign_container", "page_neighbours", "consume_carryover", "run_summary",
    "chapter_summary", "page_status", "watermark_flag", "tiles", "slices", "pace_audit", "merge_paragraphs",
    "drop_contained", "nms", "group_adjacent", "cluster_dedup", "pack_by_chars", "prepare_requests", "parse_numbered",
    "extract_links", "pick_jsonld", "chapter_progress", "stage_latency",
]


@pytest.fixture(scope="module")
def con():
    return oracle.connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, con, name):
    note = oracle.compare(con, spark, name, "/root/testdata/sf0.001", entry.queries(), entry.oracle_sql())
    assert not note or note.startswith("note"), note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).collect()
