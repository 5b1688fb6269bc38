"""Runs of line keys that were merged leave no files."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlparse

from pageloom.llm.lines import LineIndex


def test_merged_runs_are_deleted(spark):
    index = LineIndex(spark, buckets=2)
    for b in range(4):
        index.add(spark.range(20).selectExpr(f"id + {b} AS k1", "id AS k2", f"id * 0 + {b} AS _id"))
    there = {p.name for p in Path(urlparse(index.folder).path).iterdir() if p.is_dir()}
    assert there == set(index.runs) and len(index.runs) == 1
    assert index.entries().count() == 20 * 4
