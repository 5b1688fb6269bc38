"""Aggregations and reports over regions, pages, chapters and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom import constants as K
from pageloom.functions.base import first_match, strip
from pageloom.functions.cleaning import is_prompt_artifact
from pageloom.functions.geometry import Box, estimate_font_size
from pageloom.functions.script import has_cjk, has_hangul, is_failure
from pageloom.params import FontStyle
from pageloom.skew import KeyProfile, checkpoint, ordered, running_sum


def touches_border(regions: DataFrame, height: int, px: int = 8) -> DataFrame:
    """Per page: does any box touch the top or bottom border?"""
    touch = (F.col("y1") <= px) | (F.col("y2") >= height - px)
    return regions.groupBy("page_id").agg(F.bool_or(touch).alias("touches"))


# ---------------------------------------------------------------------------
# exact order statistics
# ---------------------------------------------------------------------------

def order_statistics(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]],
    profile: KeyProfile | None = None, weight: str | None = None,
) -> DataFrame:
    """Values at exact ranks (1 = smallest) per key, as doubles.

    Equal values are counted before anything is ordered, so only distinct
    values are ranked, and a key of any size is ranked in pieces.  ``ranks``
    maps a result column to a function of the group size.  A row counts as often as
    ``weight`` says.
    """
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(times.alias("_m"))
    cum = ordered(hist, keys, [value], {"_cum": running_sum(F.col("_m"))}, profile)
    total = hist.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    picks = [
        F.min(F.when(F.col("_cum") >= rank(F.col("_n")), F.col(value))).cast("double").alias(name)
        for name, rank in ranks.items()
    ]
    return cum.join(total, keys).groupBy(*keys).agg(*picks)


def nearest_rank(p: float) -> Callable[[Column], Column]:
    return lambda n: F.greatest(F.ceil(n * F.lit(p)), F.lit(1))


def percentiles(
    df: DataFrame, keys: list[str], columns: list[str], points: dict[str, float],
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Nearest-rank percentiles and maximum of several columns.

    Result columns are ``{column}_{point}`` and ``{column}_max``.
    """
    long = df.unpivot(keys, columns, "_metric", "_value")
    stats = order_statistics(
        long, [*keys, "_metric"], "_value", {name: nearest_rank(p) for name, p in points.items()}, profile
    )
    names = [*points]
    top = long.groupBy(*keys, "_metric").agg(F.max("_value").cast("double").alias("max"))
    both = stats.join(top, [*keys, "_metric"])
    picks = [
        F.max(F.when(F.col("_metric") == c, F.col(n))).alias(f"{c}_{n}")
        for c in columns for n in [*names, "max"]
    ]
    return both.groupBy(*keys).agg(*picks)


def median(
    df: DataFrame, keys: list[str], value: str, profile: KeyProfile | None = None, weight: str | None = None,
) -> DataFrame:
    """Exact median per key (mean of the two middle values)."""
    stats = order_statistics(
        df, keys, value,
        {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1}, profile, weight,
    )
    return stats.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias("median"))


# ---------------------------------------------------------------------------
# quality and status
# ---------------------------------------------------------------------------

def region_quality(regions: DataFrame, retry_label: str = "retry_translation") -> DataFrame:
    """quality_score and ordered recommendations.

    Uses confidence, glossary_cov and is_sfx; missing ones count as neutral.
    """
    conf = F.coalesce("confidence", F.lit(0.5))
    glossary = F.coalesce("glossary_cov", F.lit(1.0))
    length_fit, punctuation, model = 0.5, 1.0, 0.5
    score = (
        F.lit(0.35) * conf + F.lit(0.25 * length_fit) + F.lit(0.20) * glossary
        + F.lit(0.10 * punctuation) + F.lit(0.10 * model)
    )
    labels = F.array(
        F.when(score < 0.55, retry_label),
        F.when(conf < 0.6, "low_ocr_confidence"),
        F.when(F.lit(length_fit) < 0.7, "check_overflow"),
        F.when(~F.coalesce("is_sfx", F.lit(False)) & (glossary < 0.6), "review_glossary"),
    )
    return regions.withColumns({
        "quality_score": F.round(score, 4), "recommendations": F.array_compact(labels),
    })


def page_status(
    pages: DataFrame, regions: DataFrame, low_quality: float = 0.7, low_share: float = 0.3,
    retry_label: str = "retranslate",
) -> DataFrame:
    """Status, reason and warning counters of every page.

    ``pages``: page_id, has_report, report_valid, translated.
    ``regions``: page_id, recommendations, quality_score, confidence of the
    newest report.  ``retry_label`` is the recommendation that warns by itself.
    """
    counts = regions.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.array_contains("recommendations", retry_label)).alias("retranslate"),
        F.count_if(F.col("quality_score") < low_quality).alias("low_quality"),
        F.count_if(F.col("confidence") < 0.6).alias("low_ocr"),
    )
    read = F.col("has_report") & F.col("report_valid")
    n = F.when(read, F.coalesce("_n", F.lit(0))).otherwise(F.lit(0))
    shown = {
        c: F.when(read & (n > 0), F.coalesce(c, F.lit(0).cast("long"))).otherwise(F.lit(0)).cast("long")
        for c in ("retranslate", "low_quality", "low_ocr")
    }
    j = pages.join(counts, "page_id", "left").withColumns({**shown, "_n": n})
    warn = (F.col("retranslate") > 0) | (F.col("low_quality") / F.greatest("_n", F.lit(1)) >= low_share)
    rules = [
        (~F.col("has_report") & F.col("translated"), "success", "no_report"),
        (~F.col("has_report"), "not_started", "no_report"),
        (~F.col("report_valid"), "processing", "invalid_report"),
        (F.col("_n") == 0, "no_text", "regions_empty"),
        (warn, "warning", "quality"),
        (F.col("translated"), "success", "ok"),
        (F.lit(True), "processing", "no_output"),
    ]
    return j.select(
        "page_id", first_match([(c, s) for c, s, _ in rules]).alias("status"),
        first_match([(c, r) for c, _, r in rules]).alias("reason"),
        "retranslate", "low_quality", "low_ocr",
    )


def page_flags(regions: DataFrame) -> DataFrame:
    """Per page: region count and reply problems (one pass over the regions)."""
    target = F.coalesce("target_text", F.lit(""))
    return regions.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("region_count"),
        F.count_if(has_hangul(target)).alias("hangul_regions"),
        F.count_if(is_failure(target)).alias("failed_regions"),
        F.count_if((strip(target) == "")).alias("empty_regions"),
        F.count_if(~has_cjk(target) & target.rlike("[A-Za-z]") & ~is_failure(target)).alias("no_cjk_ascii_regions"),
        F.count_if(is_prompt_artifact(target)).alias("prompt_regions"),
    )


def chapter_summary(pages: DataFrame, flags: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Effective success of chapters.

    ``pages``: keys, page_id, ok, has_output; ``flags``: result of ``page_flags``.
    """
    keys = keys or ["chapter_id"]
    j = pages.join(flags, "page_id", "left")
    n = F.coalesce("region_count", F.lit(0))
    failed = F.coalesce("failed_regions", F.lit(0)) > 0
    effective = F.col("ok") & F.col("has_output") & ~failed & (n > 0)
    out = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(effective).alias("success_count"),
        F.count_if("ok").alias("pipeline_success_count"),
        F.count_if(~F.col("ok")).alias("failed_pipeline_count"),
        F.count_if(failed).alias("failed_translation_count"),
        F.count_if(n == 0).alias("failed_ocr_empty_count"),
        F.count_if("has_output").alias("saved_count"),
    )
    fails = F.col("total_count") - F.col("success_count")
    status = F.when(F.col("success_count") == 0, "error").when(fails > 0, "partial").otherwise("success")
    return out.withColumns({"failed_count": fails, "status": status})


def run_summary(
    pages: DataFrame, flags: DataFrame, keys: list[str], stages: list[str],
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Quality counters and exact stage percentiles of runs.

    ``pages``: keys, page_id and one column per stage duration.
    """
    j = pages.join(flags, "page_id", "left")
    has = lambda c: F.coalesce(c, F.lit(0)) > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    quality = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages_total"),
        F.count_if(has("hangul_regions")).alias("pages_has_hangul"),
        total("hangul_regions").alias("regions_with_hangul"),
        F.count_if(has("failed_regions")).alias("pages_has_failure_marker"),
        total("failed_regions").alias("regions_with_failure_marker"),
        total("no_cjk_ascii_regions").alias("no_cjk_with_ascii"),
        total("empty_regions").alias("empty_target_regions"),
        total("prompt_regions").alias("prompt_like_regions"),
    )
    times = percentiles(pages, keys, stages, {"p50": 0.5, "p95": 0.95}, profile)
    return quality.join(times, keys)


def gate(
    summary: DataFrame, baseline: DataFrame, keys: list[str], p95: str, top: str,
    p95_factor: float = 1.2, max_factor: float = 1.25,
) -> DataFrame:
    """Hard gate (nothing failed, no leak) and tail gate against a baseline."""
    base = baseline.select(*keys, F.col(p95).alias("base_p95"), F.col(top).alias("base_max"))
    j = summary.join(base, keys, "left")
    hard = (F.col("pages_has_failure_marker") == 0) & (F.col("pages_has_hangul") == 0)
    tail = (F.col(p95) <= F.col("base_p95") * F.lit(p95_factor)) & (F.col(top) <= F.col("base_max") * F.lit(max_factor))
    return j.select(
        *keys, hard.alias("hard_gate"), tail.alias("tail_gate"), (hard & tail).alias("passed"),
    )


def workload_baseline(pages: DataFrame, stages: list[str], profile: KeyProfile | None = None) -> DataFrame:
    """Per workload: percentiles of stage times, mean regions, requests and low confidence."""
    means = pages.groupBy("workload").agg(
        F.count(F.lit(1)).alias("pages"), F.avg("regions").alias("regions_avg"),
        F.avg("requests").alias("requests_avg"), F.avg("low_confidence").alias("low_confidence_avg"),
    )
    times = percentiles(pages, ["workload"], stages, {"p50": 0.5, "p95": 0.95}, profile)
    return means.join(times, "workload")


# ---------------------------------------------------------------------------
# listings
# ---------------------------------------------------------------------------

def chapter_listing(pages: DataFrame, outputs: DataFrame, keys: list[str], page_keys: list[str]) -> DataFrame:
    """Page and translated-page counts per chapter."""
    done = outputs.select(*page_keys).distinct().withColumn("_done", F.lit(True))
    out = pages.join(done, page_keys, "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("page_count"), F.count_if("_done").alias("translated_count")
    )
    return out.withColumns({
        "has_translated": F.col("translated_count") > 0,
        "is_complete": F.col("translated_count") == F.col("page_count"),
    })


def library_listing(folders: DataFrame, images: DataFrame, covers: DataFrame) -> DataFrame:
    """Series with at least one page image.

    ``folders``: series, chapter (all); ``images``: series, chapter, name;
    ``covers``: series, cover, mtime.  The newest cached cover wins over the
    first image.
    """
    first = images.groupBy("series").agg(F.min(F.struct("chapter", "name")).alias("_first"))
    cached = covers.groupBy("series").agg(F.max_by("cover", F.struct("mtime", "cover")).alias("_cover"))
    counts = folders.groupBy("series").agg(F.count_distinct("chapter").alias("chapter_count"))
    image = F.concat_ws("/", F.col("series"), F.col("_first.chapter"), F.col("_first.name"))
    return counts.join(first, "series").join(cached, "series", "left").select(
        "series", F.coalesce("_cover", image).alias("cover"), "chapter_count"
    )


# ---------------------------------------------------------------------------
# runs
# ---------------------------------------------------------------------------

def batch_totals(pages: DataFrame) -> DataFrame:
    """Totals of a batch; regions and sound effects count on success only."""
    ok = F.col("ok")
    out = pages.agg(
        F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("regions"))), F.lit(0)).alias("total_regions"),
        F.coalesce(F.sum(F.when(ok, F.col("sfx"))), F.lit(0)).alias("total_sfx"),
        F.coalesce(F.sum("elapsed_ms"), F.lit(0)).alias("total_time"),
    )
    n = F.col("success") + F.col("failed")
    return out.withColumn("avg_time", F.when(n > 0, F.col("total_time") / n).otherwise(F.lit(0.0)))


def stage_breakdown(stages: DataFrame, keys: list[str]) -> DataFrame:
    """Duration and percent of the total per stage.

    ``stages``: keys, stage, duration_ms.
    """
    per = stages.groupBy(*keys, "stage").agg(F.sum("duration_ms").alias("duration_ms"))
    total = stages.groupBy(*keys).agg(F.sum("duration_ms").alias("total_ms"))
    pct = F.when(F.col("total_ms") > 0, F.col("duration_ms") / F.col("total_ms") * 100).otherwise(F.lit(0.0))
    return per.join(total, keys).withColumn("percent", pct)


def stage_timings(stages: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One column per stage."""
    return stages.groupBy(*keys).pivot("stage", names).agg(F.sum("duration_ms"))


def counter_rollup(tasks: DataFrame, keys: list[str], counters: str = "sub_metrics") -> DataFrame:
    """Sums of the fixed counters; only non-negative whole numbers count."""
    def value(key: str) -> Column:
        raw = F.try_element_at(F.col(counters), F.lit(key))
        number = F.when(raw.rlike(r"^\d+\z"), raw.try_cast("long"))
        return F.coalesce(F.sum(number), F.lit(0)).cast("long").alias(key)

    return tasks.groupBy(*keys).agg(*[value(k) for k in K.COUNTER_KEYS])


def value_stats(
    before: DataFrame, after: DataFrame, key: str, value: str, min_gain: float = 0.05,
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Average, median and count on both sides, the gain, and whether to keep it."""
    def side(df: DataFrame, name: str) -> DataFrame:
        stats = df.groupBy(key).agg(F.avg(value).alias(f"{name}_avg"), F.count(value).alias(f"{name}_count"))
        mid = median(df, [key], value, profile).withColumnRenamed("median", f"{name}_median")
        return stats.join(mid, key, "left")

    j = side(before, "before").join(side(after, "after"), key, "full")
    cols = {
        f"{s}_{m}": F.coalesce(f"{s}_{m}", F.lit(0.0)) for s in ("before", "after") for m in ("avg", "median")
    } | {f"{s}_count": F.coalesce(f"{s}_count", F.lit(0).cast("long")) for s in ("before", "after")}
    j = j.withColumns(cols)
    old, new = F.col("before_avg"), F.col("after_avg")
    gain = F.when(old > 0, (new - old) / old).otherwise(F.lit(0.0))
    return j.withColumn("gain_ratio", gain).withColumn("suggest_keep", F.col("gain_ratio") >= min_gain)


def consistency_summary(joined: DataFrame, profile: KeyProfile | None = None) -> DataFrame:
    """One row of totals over the result of ``consistency_join``.

    The readings are compared once: all totals come from the counts of equal outcomes.
    """
    counts = checkpoint(joined.groupBy("skip", "match", "similarity").agg(F.count(F.lit(1)).alias("_n")))
    scored = F.when(F.col("similarity").isNotNull(), F.col("_n"))
    times = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).cast("long")
    out = counts.agg(
        times(F.col("skip").isNull()).alias("total"),
        times(F.col("match")).alias("matched"),
        times(~F.col("match")).alias("mismatch"),
        F.coalesce(F.sum(F.col("similarity") * F.col("_n")) / F.sum(scored), F.lit(0.0)).alias("avg_similarity"),
        F.coalesce(F.min("similarity"), F.lit(0.0)).alias("min_similarity"),
        F.coalesce(F.max("similarity"), F.lit(0.0)).alias("max_similarity"),
        times(F.col("skip") == "no_box").alias("skipped_no_box"),
        times(F.col("skip") == "empty_text").alias("skipped_empty_text"),
        times(F.col("skip") == "too_small").alias("skipped_too_small"),
    ).withColumn("_all", F.lit(0))
    scored_rows = counts.where("skip IS NULL").select(F.lit(0).alias("_all"), "similarity", "_n")
    mid = median(scored_rows, ["_all"], "similarity", profile, "_n")
    return out.join(mid, "_all", "left").withColumn(
        "median_similarity", F.coalesce("median", F.lit(0.0))
    ).drop("_all", "median")


def bad_samples(joined: DataFrame, n: int = 50, order: str = "region_id") -> DataFrame:
    """First ``n`` mismatches of the report."""
    return joined.where("skip IS NULL AND NOT match").orderBy(order).limit(n)


def download_summary(downloads: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and status per chapter."""
    out = downloads.groupBy(*keys).agg(
        F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failed_count")
    )
    status = F.when(F.col("success_count") == 0, "error").when(F.col("failed_count") > 0, "partial").otherwise("success")
    return out.withColumn("status", status)


def series_progress(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters with at least one download, of all."""
    return chapters.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("downloaded_count") > 0).alias("done")
    )


def group_font_size(regions: DataFrame, style: FontStyle = FontStyle()) -> DataFrame:
    """Common font size of containers with two or more drawn regions.

    ``regions``: page_id, container_id, box, source_text, target_text.
    Rounded half to even.  Containers without a usable estimate are left out.
    """
    target = F.coalesce("target_text", F.lit(""))
    drawn = regions.where(
        (target != "") & ~target.startswith(K.SFX_PREFIX) & (target != K.ERASE_ONLY)
        & F.col("container_id").isNotNull() & F.col("x1").isNotNull()
    )
    length = F.length(strip(F.coalesce("source_text", F.lit(""))))
    size = F.when(length > 0, estimate_font_size(Box(), length, style=style))
    # sizes are whole numbers from 12 to 48: the median needs a few counts only
    out = drawn.groupBy("page_id", "container_id").agg(
        F.count(F.lit(1)).alias("_n"), F.median(size).alias("_median")
    )
    return out.where("_n > 1 AND _median IS NOT NULL").select(
        "page_id", "container_id", F.bround("_median", 0).cast("long").alias("font_size_ref")
    )


def with_font_override(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Regions with the common size of their container where there is one."""
    j = regions.join(sizes, ["page_id", "container_id"], "left")
    return j.withColumn("font_size_source", F.when(F.col("font_size_ref").isNotNull(), "override"))


def error_breakdown(tasks: DataFrame) -> DataFrame:
    """Failed tasks per error code, with the HTTP class they map to."""
    code = F.coalesce(F.when(F.col("error_code") != "", F.col("error_code")), F.lit("pipeline_failed"))
    http = F.when(F.col("code") == "ocr_no_text", 422).otherwise(500)
    out = tasks.where(~F.col("ok")).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("tasks"))
    return out.withColumn("http_status", http)


LOG_PATTERNS = {
    "timeouts": r"primary timeout after \d+ms",
    "fallbacks": r"fallback provider=",
    "missing_numbers": r"missing number|missing items",
    "overloads": r"\b503\b",
}


def log_counters(logs: DataFrame, keys: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """Lines per run that hit each pattern."""
    hits = [F.count_if(F.col("message").rlike(p)).alias(n) for n, p in (patterns or LOG_PATTERNS).items()]
    return logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), *hits)


def queue_wait(tasks: DataFrame) -> DataFrame:
    """queue_wait_ms = start - created, never negative."""
    micros = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("started_at"))
    return tasks.withColumn("queue_wait_ms", F.greatest(F.lit(0.0), F.coalesce(micros / 1000, F.lit(0.0))))


def explain_gap(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Stage wall time against the internal total: mean and largest gap in percent."""
    gap = F.when(F.col("stage_ms") > 0, (F.col("stage_ms") - F.col("internal_ms")) / F.col("stage_ms") * 100).otherwise(F.lit(0.0))
    return tasks.withColumn("_gap", gap).groupBy(*keys).agg(
        F.avg("_gap").alias("gap_avg"), F.max("_gap").alias("gap_max"),
        F.count_if(F.col("_gap") > 10).alias("unexplained"),
    )


def merge_warnings(existing: Column, new: Column) -> Column:
    """Existing non-empty warnings, then the new ones."""
    empty = F.array().cast("array<string>")
    old = F.filter(F.coalesce(existing, empty), lambda s: s != "")
    return F.concat(old, F.coalesce(new, empty))
