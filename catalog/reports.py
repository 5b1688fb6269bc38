"""Report queries over pages, chapters and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import query
from catalog.text import KIND  # noqa: F401
from pageloom.constants import COUNTER_KEYS
from pageloom.operators import joins as J
from pageloom.operators import reports as R
from pageloom.params import FontStyle

STAGES = ["ocr_ms", "translator_ms", "inpainter_ms", "renderer_ms"]
T = "coalesce(target_text, '')"
HITS = " + ".join(f"contains(lower({T}), '{h}')::INT" for h in ("assistant", "translate", "output only", "numbered", "json", "system prompt"))
FLAGS = f""", flags AS (SELECT page_id, count(*) AS region_count,
   count(*) FILTER ({S.has(T, S.HANGUL_WIDE)}) AS hangul_regions,
   count(*) FILTER ({S.failure(T)}) AS failed_regions,
   count(*) FILTER ({S.strip(T)} = '') AS empty_regions,
   count(*) FILTER (NOT {S.has_cjk(T)} AND {S.has(T, '[A-Za-z]')} AND NOT {S.failure(T)}) AS no_cjk_ascii_regions,
   count(*) FILTER (length({T}) >= 24 AND NOT starts_with({T}, '[翻译失败]') AND {HITS} > 0
     AND (((contains(lower({T}), 'assistant') OR contains(lower({T}), 'translate') OR contains(lower({T}), 'output only')) AND {S.english(T)} >= 0.15)
       OR ({HITS} >= 2 AND {S.english(T)} >= 0.2))) AS prompt_regions
  FROM regions GROUP BY page_id)
"""


@query("page_flags", FLAGS + "SELECT * FROM flags", ("regions",))
def _(t):
    return R.page_flags(t.regions)


def _pct(cols):
    return ", ".join(
        f"CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS {c}_p50, CAST(quantile_disc({c}, 0.95) AS DOUBLE) AS {c}_p95, CAST(max({c}) AS DOUBLE) AS {c}_max"
        for c in cols
    )


RUN_SQL = FLAGS + f"""SELECT series_id, count(*) AS pages_total, count(*) FILTER (hangul_regions > 0) AS pages_has_hangul,
   CAST(sum(hangul_regions) AS BIGINT) AS regions_with_hangul, count(*) FILTER (failed_regions > 0) AS pages_has_failure_marker,
   CAST(sum(failed_regions) AS BIGINT) AS regions_with_failure_marker, CAST(sum(no_cjk_ascii_regions) AS BIGINT) AS no_cjk_with_ascii,
   CAST(sum(empty_regions) AS BIGINT) AS empty_target_regions, CAST(sum(prompt_regions) AS BIGINT) AS prompt_like_regions, {_pct(STAGES)}
 FROM page_facts JOIN flags USING (page_id) GROUP BY series_id"""


def run_summary(t):
    # every (series, stage) group holds at most one row per page of the series
    profile = t.profile("series", t._paged_lines.select(
        F.floor(F.col("page_id") / 120).cast("long").alias("series_id"), "page_id").distinct(), ["series_id"])
    return R.run_summary(t.page_facts, R.page_flags(t.regions), ["series_id"], STAGES, profile)


@query("run_summary", RUN_SQL, ("regions", "page_facts"))
def _(t):
    """Flagship: quality counters and exact stage percentiles per series."""
    return run_summary(t)


@query("gate", FLAGS + f""", s AS (SELECT series_id, count(*) FILTER (hangul_regions > 0) AS hang, count(*) FILTER (failed_regions > 0) AS fail,
    {_pct(STAGES)} FROM page_facts JOIN flags USING (page_id) GROUP BY series_id)
 SELECT a.series_id, a.hang = 0 AND a.fail = 0 AS hard_gate,
   a.translator_ms_p95 <= b.translator_ms_p95*1.2 AND a.translator_ms_max <= b.translator_ms_max*1.25 AS tail_gate,
   a.hang = 0 AND a.fail = 0 AND a.translator_ms_p95 <= b.translator_ms_p95*1.2 AND a.translator_ms_max <= b.translator_ms_max*1.25 AS passed
 FROM s a LEFT JOIN s b ON b.series_id = a.series_id - 1""", ("regions", "page_facts"))
def _(t):
    """Each series against the one before it."""
    s = run_summary(t)
    base = s.withColumn("series_id", F.col("series_id") + 1)
    return R.gate(s, base, ["series_id"], "translator_ms_p95", "translator_ms_max")


@query("region_quality", """SELECT region_id, round(0.35::DOUBLE*confidence + 0.125::DOUBLE + 0.2::DOUBLE*g + 0.1::DOUBLE + 0.05::DOUBLE, 4) AS quality_score,
   concat_ws(',', CASE WHEN 0.35::DOUBLE*confidence + 0.125::DOUBLE + 0.2::DOUBLE*g + 0.1::DOUBLE + 0.05::DOUBLE < 0.55 THEN 'retry_translation' END,
     CASE WHEN confidence < 0.6 THEN 'low_ocr_confidence' END, 'check_overflow',
     CASE WHEN NOT sfx AND g < 0.6 THEN 'review_glossary' END) AS recs
  FROM (SELECT *, CAST(region_id % 5 AS DOUBLE)/4 AS g, region_id % 3 = 0 AS sfx FROM lines)""", ("lines",))
def _(t):
    df = t.lines.withColumns({"glossary_cov": (F.col("region_id") % 5) / F.lit(4.0), "is_sfx": F.col("region_id") % 3 == 0})
    return R.region_quality(df).select("region_id", "quality_score", F.concat_ws(",", "recommendations").alias("recs"))


@query("page_status", """, r AS (SELECT page_id, count(*) AS n, count(*) FILTER (region_id % 301 = 0) AS retranslate,
     count(*) FILTER (0.35::DOUBLE*confidence + 0.475::DOUBLE < 0.7) AS low_quality, count(*) FILTER (confidence < 0.6) AS low_ocr
   FROM lines GROUP BY page_id),
 p AS (SELECT page_id, page_id % 6 <> 0 AS has_report, page_id % 17 <> 0 AS valid, has_output FROM page_facts),
 j AS (SELECT p.*, has_report AND valid AS rd, CASE WHEN has_report AND valid THEN coalesce(n, 0) ELSE 0 END AS n2, retranslate, low_quality, low_ocr FROM p LEFT JOIN r USING (page_id)),
 k AS (SELECT page_id, has_report, valid, has_output, n2, CASE WHEN n2 > 0 THEN retranslate ELSE 0 END AS retranslate,
   CASE WHEN n2 > 0 THEN low_quality ELSE 0 END AS low_quality, CASE WHEN n2 > 0 THEN low_ocr ELSE 0 END AS low_ocr FROM j)
 SELECT page_id, CASE WHEN NOT has_report THEN CASE WHEN has_output THEN 'success' ELSE 'not_started' END WHEN NOT valid THEN 'processing' WHEN n2 = 0 THEN 'no_text'
     WHEN retranslate > 0 OR low_quality/greatest(n2,1) >= 0.3 THEN 'warning' WHEN has_output THEN 'success' ELSE 'processing' END AS status,
   CASE WHEN NOT has_report THEN 'no_report' WHEN NOT valid THEN 'invalid_report' WHEN n2 = 0 THEN 'regions_empty'
     WHEN retranslate > 0 OR low_quality/greatest(n2,1) >= 0.3 THEN 'quality' WHEN has_output THEN 'ok' ELSE 'no_output' END AS reason,
   retranslate, low_quality, low_ocr FROM k""", ("lines", "page_facts"))
def _(t):
    rows = t.lines.select(
        "page_id", "confidence", (F.lit(0.35) * F.col("confidence") + F.lit(0.475)).alias("quality_score"),
        F.when(F.col("region_id") % 301 == 0, F.array(F.lit("retranslate"))).otherwise(F.array(F.lit("retry_translation"))).alias("recommendations"),
    )
    pages = t.page_facts.select(
        "page_id", (F.col("page_id") % 6 != 0).alias("has_report"), (F.col("page_id") % 17 != 0).alias("report_valid"),
        F.col("has_output").alias("translated"),
    )
    return R.page_status(pages, rows)


@query("chapter_summary", FLAGS + """, j AS (SELECT f.*, coalesce(failed_regions, 0) > 0 AS bad, coalesce(region_count, 0) AS n
    FROM page_facts f LEFT JOIN flags USING (page_id)),
  c AS (SELECT chapter_id, count(*) AS total_count, count(*) FILTER (ok AND has_output AND NOT bad AND n > 0) AS success_count,
   count(*) FILTER (ok) AS pipeline_success_count, count(*) FILTER (NOT ok) AS failed_pipeline_count, count(*) FILTER (bad) AS failed_translation_count,
   count(*) FILTER (n = 0) AS failed_ocr_empty_count, count(*) FILTER (has_output) AS saved_count FROM j GROUP BY chapter_id)
 SELECT *, total_count - success_count AS failed_count,
   CASE WHEN success_count = 0 THEN 'error' WHEN total_count > success_count THEN 'partial' ELSE 'success' END AS status FROM c""", ("regions", "page_facts"))
def _(t):
    flags = R.page_flags(t.regions)
    return R.chapter_summary(t.page_facts, flags)


@query("chapter_listing", """SELECT series_id, chapter_id, count(*) AS page_count, count(*) FILTER (has_output) AS translated_count,
  count(*) FILTER (has_output) > 0 AS has_translated, count(*) FILTER (has_output) = count(*) AS is_complete FROM page_facts GROUP BY 1, 2""", ("page_facts",))
def _(t):
    pages = t.page_facts.select("series_id", "chapter_id", "page_id", "has_output")
    return R.chapter_listing(pages.drop("has_output"), pages.where("has_output"), ["series_id", "chapter_id"], ["page_id"])


@query("library_listing", """, im AS (SELECT DISTINCT 's' || series_id AS series, 'c' || lpad(chapter_id::VARCHAR, 9, '0') AS chapter, lpad(page_no::VARCHAR, 3, '0') || '.jpg' AS name
     FROM page_facts),
  fo AS (SELECT DISTINCT 's' || series_id AS series, 'c' || lpad(chapter_id::VARCHAR, 9, '0') AS chapter FROM page_facts),
  co AS (SELECT 's' || (c_custkey % 40) AS series, 'cache/' || c_custkey || '.png' AS cover, c_custkey % 77 AS mtime FROM customer),
  fi AS (SELECT series, min(series || '/' || chapter || '/' || name) AS first_image FROM im GROUP BY 1),
  ca AS (SELECT series, cover FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mtime DESC, cover DESC) rn FROM co) WHERE rn = 1)
 SELECT fo.series, coalesce(any_value(cover), any_value(first_image)) AS cover, count(DISTINCT chapter) AS chapter_count
 FROM fo JOIN fi USING (series) LEFT JOIN ca USING (series) GROUP BY fo.series""", ("page_facts",))
def _(t):
    name = lambda p, c, n: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), n, "0"))
    series = F.concat(F.lit("s"), F.col("series_id").cast("string")).alias("series")
    folders = t.page_facts.select(series, name("c", "chapter_id", 9).alias("chapter")).distinct()
    images = t.page_facts.select(
        series, name("c", "chapter_id", 9).alias("chapter"), F.concat(F.lpad(F.col("page_no").cast("string"), 3, "0"), F.lit(".jpg")).alias("name")
    )
    covers = t.customer.select(
        F.concat(F.lit("s"), (F.col("c_custkey") % 40).cast("string")).alias("series"),
        F.concat(F.lit("cache/"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("cover"),
        (F.col("c_custkey") % 77).alias("mtime"),
    )
    return R.library_listing(folders, images, covers)


TOTAL = "(ocr_ms + translator_ms + inpainter_ms + renderer_ms)"


@query("batch_totals", f"""SELECT count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed, CAST(sum(regions) FILTER (ok) AS BIGINT) AS total_regions,
  CAST(sum(regions % 4) FILTER (ok) AS BIGINT) AS total_sfx, CAST(sum{TOTAL} AS BIGINT) AS total_time, sum{TOTAL}/count(*) AS avg_time FROM page_facts""", ("page_facts",))
def _(t):
    total = sum((F.col(c) for c in STAGES), F.lit(0))
    return R.batch_totals(t.page_facts.withColumns({"sfx": F.col("regions") % 4, "elapsed_ms": total}))


def stage_rows(t):
    return t.page_facts.unpivot(["page_id", "chapter_id"], STAGES, "stage", "duration_ms")


STAGE_SQL = """, st AS (SELECT chapter_id, page_id, stage, duration_ms FROM page_facts UNPIVOT (duration_ms FOR stage IN (ocr_ms, translator_ms, inpainter_ms, renderer_ms)))
"""


@query("stage_breakdown", STAGE_SQL + """SELECT chapter_id, stage, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(any_value(tot) AS BIGINT) AS total_ms,
   CASE WHEN any_value(tot) > 0 THEN sum(duration_ms)/any_value(tot)*100 ELSE 0.0 END AS percent
 FROM st JOIN (SELECT chapter_id, sum(duration_ms) AS tot FROM st GROUP BY 1) USING (chapter_id) GROUP BY 1, 2""", ("page_facts",))
def _(t):
    return R.stage_breakdown(stage_rows(t), ["chapter_id"])


@query("stage_timings", "SELECT chapter_id, " + ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in STAGES) + " FROM page_facts GROUP BY 1", ("page_facts",))
def _(t):
    return R.stage_timings(stage_rows(t), ["chapter_id"], STAGES)


@query("counter_rollup", """SELECT l_suppkey AS run, CAST(sum(CASE WHEN l_orderkey % 10 <> 0 THEN l_partkey % 5 END) AS BIGINT) AS requests_primary,
   CAST(sum(l_linenumber) FILTER (l_linenumber <> 3) AS BIGINT) AS requests_fallback, 0::BIGINT AS timeouts_primary,
   CAST(sum(l_orderkey % 2) AS BIGINT) AS fallback_provider_calls, 0::BIGINT AS missing_number_retries FROM lineitem GROUP BY 1""")
def _(t):
    s = lambda c: c.cast("string")
    subs = F.create_map(
        F.lit(COUNTER_KEYS[0]), F.when(F.col("l_orderkey") % 10 != 0, s(F.col("l_partkey") % 5)).otherwise("n/a"),
        F.lit(COUNTER_KEYS[1]), F.when(F.col("l_linenumber") == 3, "-3").otherwise(s(F.col("l_linenumber"))),
        F.lit(COUNTER_KEYS[2]), F.lit("1.5"), F.lit(COUNTER_KEYS[3]), s(F.col("l_orderkey") % 2),
    )
    return R.counter_rollup(t.lineitem.select(F.col("l_suppkey").alias("run"), subs.alias("sub_metrics")), ["run"])


@query("workload_baseline", f"""SELECT 'w' || (series_id % 3) AS workload, count(*) AS pages, avg(regions) AS regions_avg, avg(page_id % 4) AS requests_avg,
   avg(page_id % 3) AS low_confidence_avg, {_pct(['ocr_ms', 'translator_ms'])} FROM page_facts GROUP BY 1""", ("page_facts",))
def _(t):
    pages = t.page_facts.select(
        F.concat(F.lit("w"), (F.col("series_id") % 3).cast("string")).alias("workload"), "regions",
        (F.col("page_id") % 4).alias("requests"), (F.col("page_id") % 3).alias("low_confidence"), "ocr_ms", "translator_ms",
    )
    return R.workload_baseline(pages, ["ocr_ms", "translator_ms"])


@query("value_stats", """, a AS (SELECT page_id, avg(confidence) FILTER (pos % 2 = 0) AS before_avg, count(*) FILTER (pos % 2 = 0) AS before_count, median(confidence) FILTER (pos % 2 = 0) AS before_median,
    avg(confidence) FILTER (pos % 2 = 1) AS after_avg, count(*) FILTER (pos % 2 = 1) AS after_count, median(confidence) FILTER (pos % 2 = 1) AS after_median FROM lines GROUP BY 1),
  b AS (SELECT page_id, coalesce(before_avg, 0.0) AS before_avg, before_count, coalesce(before_median, 0.0) AS before_median, coalesce(after_avg, 0.0) AS after_avg, after_count, coalesce(after_median, 0.0) AS after_median FROM a)
 SELECT *, CASE WHEN before_avg > 0 THEN (after_avg-before_avg)/before_avg ELSE 0.0 END AS gain_ratio,
   CASE WHEN before_avg > 0 THEN (after_avg-before_avg)/before_avg ELSE 0.0 END >= 0.05 AS suggest_keep FROM b""", ("lines",))
def _(t):
    even, odd = t.lines.where("pos % 2 = 0"), t.lines.where("pos % 2 = 1")
    return R.value_stats(even, odd, "page_id", "confidence", profile=t.page_profile)


def _consistency(t):
    second = t.regions.select("page_id", "region_id", F.upper(F.substring("source_text", 1, 14)).alias("source_text"))
    return J.consistency_join(t.regions, second, 2.0, 2.0, 1600, 4000, min_box=30)


@query("consistency_summary")
def _(t):
    return R.consistency_summary(_consistency(t))


@query("bad_samples")
def _(t):
    return R.bad_samples(_consistency(t), 50)


DOWN = """, dl AS (SELECT chapter_id, series_id, ok FROM page_facts)
"""


@query("download_summary", """SELECT series_id, chapter_id, count(*) FILTER (ok AND chapter_id % 4 <> 1) AS success_count, count(*) FILTER (NOT (ok AND chapter_id % 4 <> 1)) AS failed_count,
   CASE WHEN count(*) FILTER (ok AND chapter_id % 4 <> 1) = 0 THEN 'error' WHEN count(*) FILTER (NOT (ok AND chapter_id % 4 <> 1)) > 0 THEN 'partial' ELSE 'success' END AS status
 FROM page_facts GROUP BY 1, 2""", ("page_facts",))
def _(t):
    d = t.page_facts.withColumn("ok", F.col("ok") & (F.col("chapter_id") % 4 != 1))
    return R.download_summary(d, ["series_id", "chapter_id"])


@query("series_progress", """SELECT series_id, count(*) AS total, count(*) FILTER (n > 0) AS done FROM
  (SELECT series_id, chapter_id, count(*) FILTER (ok AND chapter_id % 4 <> 1) AS n FROM page_facts GROUP BY 1, 2) GROUP BY 1""", ("page_facts",))
def _(t):
    d = t.page_facts.withColumn("ok", F.col("ok") & (F.col("chapter_id") % 4 != 1))
    done = R.download_summary(d, ["series_id", "chapter_id"]).withColumnRenamed("success_count", "downloaded_count")
    return R.series_progress(done, ["series_id"])


def _font(n, w, h, spacing, bias):
    lines = f"greatest(ceil(sqrt({n}*{h}/({w}*{spacing}::DOUBLE))), 1)"
    return f"floor(greatest(12.0, least(48.0, {bias}::DOUBLE*least({w}/greatest(ceil({n}/{lines}),1), {h}/({lines}*{spacing}::DOUBLE)))))"


@query("group_font_size", f""", k AS (SELECT page_id, pos // 4 AS container_id, length({S.strip('source_text')}) AS n, (x2-x1)*0.8::DOUBLE AS w, (y2-y1)*0.8::DOUBLE AS h
    FROM regions WHERE coalesce(target_text, '') <> '' AND NOT starts_with(target_text, '[SFX:') AND target_text <> '[INPAINT_ONLY]'),
  z AS (SELECT *, {_font('n', 'w', 'h', 1.2, 1.0)} AS size, {_font('n', 'w', 'h', 1.1, 1.0)} AS tight, greatest(ceil(sqrt(n*h/(w*1.2::DOUBLE))), 1) AS rws FROM k),
  e AS (SELECT page_id, container_id, CASE WHEN n > 0 THEN CASE WHEN w <= 0 OR h <= 0 THEN 12 WHEN rws*size*1.2::DOUBLE > h*0.9::DOUBLE THEN greatest(size, tight) ELSE size END END AS est FROM z)
 SELECT page_id, container_id, CAST(round_even(median(est), 0) AS BIGINT) AS font_size_ref FROM e GROUP BY 1, 2 HAVING count(*) > 1 AND median(est) IS NOT NULL""", ("regions",))
def _(t):
    df = t.regions.withColumn("container_id", F.floor(F.col("pos") / 4))
    return R.group_font_size(df, FontStyle())


@query("error_breakdown", """SELECT CASE WHEN page_id % 21 = 0 THEN 'ocr_no_text' WHEN page_id % 14 = 0 THEN 'timeout' ELSE 'pipeline_failed' END AS code, count(*) AS tasks,
   CASE WHEN page_id % 21 = 0 THEN 422 ELSE 500 END AS http_status FROM page_facts WHERE NOT ok GROUP BY 1, 3""", ("page_facts",))
def _(t):
    code = F.when(F.col("page_id") % 21 == 0, "ocr_no_text").when(F.col("page_id") % 14 == 0, "timeout").otherwise("")
    return R.error_breakdown(t.page_facts.withColumn("error_code", code))


LOGS = """, logs AS (SELECT event_id % 20 AS run, CASE event_type WHEN 'click' THEN 'primary timeout after ' || event_id || 'ms'
  WHEN 'view' THEN 'batch: fallback provider=x model=y' WHEN 'signup' THEN 'AI response missing number ' || event_id WHEN 'error' THEN 'HTTP 503 from host' ELSE 'ok ' || props END AS message FROM events)
"""


@query("log_counters", "WITH " + LOGS.strip()[1:] + r""" SELECT run, count(*) AS lines, count(*) FILTER (regexp_matches(message, 'primary timeout after [0-9]+ms')) AS timeouts,
  count(*) FILTER (contains(message, 'fallback provider=')) AS fallbacks, count(*) FILTER (regexp_matches(message, 'missing number|missing items')) AS missing_numbers,
  count(*) FILTER (regexp_matches(message, '\b503\b')) AS overloads FROM logs GROUP BY 1""")
def _(t):
    e, i = F.col("event_type"), F.col("event_id").cast("string")
    message = (
        F.when(e == "click", F.concat(F.lit("primary timeout after "), i, F.lit("ms")))
        .when(e == "view", "batch: fallback provider=x model=y")
        .when(e == "signup", F.concat(F.lit("AI response missing number "), i))
        .when(e == "error", "HTTP 503 from host").otherwise(F.concat(F.lit("ok "), F.col("props")))
    )
    return R.log_counters(t.events.select((F.col("event_id") % 20).alias("run"), message.alias("message")), ["run"])


@query("queue_wait", """SELECT event_id, greatest(0.0, (epoch_us(ts) - epoch_us(ts) // 1000000 * 1000000 - 300000)/1000) AS queue_wait_ms FROM events""")
def _(t):
    created = F.date_trunc("second", "ts") + F.expr("INTERVAL '0.3' SECOND")
    return R.queue_wait(t.events.withColumns({"created_at": created, "started_at": F.col("ts")})).select("event_id", "queue_wait_ms")


@query("explain_gap", """SELECT chapter_id, avg(g) AS gap_avg, max(g) AS gap_max, count(*) FILTER (g > 10) AS unexplained FROM
  (SELECT chapter_id, CASE WHEN translator_ms > 0 THEN (translator_ms - translator_ms*(80 + page_id % 20)/100)/translator_ms*100 ELSE 0.0 END AS g FROM page_facts) GROUP BY 1""", ("page_facts",))
def _(t):
    tasks = t.page_facts.select(
        "chapter_id", F.col("translator_ms").alias("stage_ms"), (F.col("translator_ms") * (F.col("page_id") % 20 + 80) / 100).alias("internal_ms")
    )
    return R.explain_gap(tasks, ["chapter_id"])


@query("merge_warnings", """SELECT event_id, concat_ws('|', CASE WHEN event_id % 3 <> 0 THEN props END, 'low ' || event_type) AS warnings, CAST(CASE WHEN event_id % 3 <> 0 THEN 2 ELSE 1 END AS INT) AS n FROM events""")
def _(t):
    old = F.when(F.col("event_id") % 3 != 0, F.array(F.col("props"), F.lit("")))
    w = R.merge_warnings(old, F.array(F.concat(F.lit("low "), F.col("event_type"))))
    return t.events.select("event_id", w.alias("w")).select("event_id", F.concat_ws("|", "w").alias("warnings"), F.size("w").alias("n"))
