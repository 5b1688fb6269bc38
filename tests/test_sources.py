"""Readers and writers round trip."""

import json

from pyspark.sql import functions as F

from pageloom.operators.reports import log_counters, page_status
from pageloom.sources import files as S


def test_reports(spark, tmp_path):
    doc = {
        "task_id": "t1", "image_path": "data/raw/Series A/ch-1/7.jpg", "success": True, "timings_ms": {"ocr": 100.0, "total": 1234.0},
        "translator_counters": {"requests_primary": 2}, "regions": [
            {"region_id": "r1", "source_text": "Hello", "target_text": "你好", "confidence": 0.9, "box_2d": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, "recommendations": ["retranslate"]},
        ],
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2))
    (tmp_path / "in" / "b.json").write_text("{ broken")
    reports, regions = S.read_reports(spark, str(tmp_path / "in"))
    assert {(r.task_id, r.valid, r.region_count) for r in reports.collect()} == {("t1", True, 1), (None, False, 0)}
    row = regions.first()
    assert (row.source_text, row.box_2d.x2, row.recommendations) == ("Hello", 3, ["retranslate"])
    S.write_reports(reports.where("valid"), regions, str(tmp_path / "out"))
    again = spark.read.json(str(tmp_path / "out")).first()
    assert again.report_name == "series_a__ch-1__7__t1" and again.regions[0].target_text == "你好"


def test_page_status_cases(spark):
    pages = spark.createDataFrame([(1, True, True, True), (2, False, True, False), (3, True, True, True), (4, True, False, True)], "page_id long, has_report boolean, report_valid boolean, translated boolean")
    rows = spark.createDataFrame([(3, ["retranslate"], 0.9, 0.9)], "page_id long, recommendations array<string>, quality_score double, confidence double")
    got = {r.page_id: (r.status, r.retranslate) for r in page_status(pages, rows).collect()}
    assert got == {1: ("no_text", 0), 2: ("not_started", 0), 3: ("warning", 1), 4: ("processing", 0)}


def test_manifests(spark, tmp_path):
    df = spark.createDataFrame([("m", "c", 2, "u2", "p2", False, "x"), ("m", "c", 1, "u1", "p1", True, None)], "manga_id string, chapter_id string, index int, url string, path string, ok boolean, error string")
    S.write_manifests(df, str(tmp_path / "m"))
    # Spark writes one document per line; single documents are read the same way
    (tmp_path / "bad.json").write_text('{"pages": 3}')
    chapters, pages = S.read_manifests(spark, str(tmp_path))
    assert {(r.chapter_id, r.ok_count, r.total) for r in chapters.collect()} == {("c", 1, 2), (None, None, None)}
    assert [r.url for r in pages.orderBy("index").collect()] == ["u1", "u2"]


def test_library_scan(spark, tmp_path):
    for name in ("s/c1/1.jpg", "s/c1/10.PNG", "s/c1/2.webp", "s/c1/notes.txt"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    rows = S.scan_library(spark, str(tmp_path)).orderBy("page_no").collect()
    assert [(r.series, r.chapter, r.name) for r in rows] == [("s", "c1", "1.jpg"), ("s", "c1", "2.webp"), ("s", "c1", "10.PNG")]


def test_logs(spark, tmp_path):
    (tmp_path / "20260101_app.log").write_text("2026-01-01 | INFO | a | old\n")
    (tmp_path / "20260102_app.log").write_text("2026-01-02 | ERROR | ai | primary timeout after 15000ms\n2026-01-02 | INFO | ai | fallback provider=x\nplain\n")
    logs = S.read_app_logs(spark, str(tmp_path))
    assert [r.value for r in S.latest_tail(logs, 2).orderBy("line_id").collect()] == ["2026-01-02 | INFO | ai | fallback provider=x", "plain"]
    counts = log_counters(logs, ["file"]).orderBy("file").collect()[-1]
    assert (counts.lines, counts.timeouts, counts.fallbacks) == (3, 1, 1)


def test_access_log(spark, tmp_path):
    (tmp_path / "access.log").write_text('9.9.9.9 - - [10/Feb/2026:06:00:00 +0000] "GET /.env HTTP/1.1" 404 153 "-" "curl"\nbroken\n')
    row = S.read_access_log(spark, str(tmp_path / "access.log")).collect()
    assert [(r.host, r.path, r.code, r.bytes) for r in row] == [("9.9.9.9", "/.env", 404, 153)]


def test_carryover_and_slices(spark, tmp_path):
    df = spark.createDataFrame([("p", "文", "1", "next", 1.5, "pending")], S.CARRYOVER)
    S.append_carryover(df, str(tmp_path / "c"))
    S.append_carryover(df, str(tmp_path / "c"))
    assert [r.bottom_text for r in S.read_carryover(spark, str(tmp_path / "c")).collect()] == ["文", "文"]
    spans = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 90, 150)], "page int, index int, start int, end int").withColumns({"w": F.lit(50), "h": F.lit(150)})
    S.write_slice_index(spans, str(tmp_path / "s"), "w", "h", 100, 10)
    got = S.read_slice_index(spark, str(tmp_path / "s")).orderBy("index").collect()
    assert [(r.file, r.y, r.height) for r in got] == [("slice_000.webp", 0, 100), ("slice_001.webp", 90, 60)]


def test_eval_formats(spark, tmp_path):
    df = spark.createDataFrame([("a.png", "b.png", 0.1, True, 5)], "image string, upscaled string, gain_ratio double, suggest_keep boolean, extra int")
    S.write_eval(df, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["image", "upscaled", "gain_ratio", "suggest_keep"]
