"""Ordered operators: neighbours, marks, budgets, generators, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom import constants as K
from pageloom.functions.base import any_of
from pageloom.functions.cleaning import watermark_compact, watermark_key, watermark_lower
from pageloom.functions.geometry import Box, near_edge, similar_pos
from pageloom.params import TileRule
from pageloom.skew import KeyProfile, following, ordered, previous, rank, running_max, running_sum


def neighbour_context(groups: DataFrame, cap: int = 0, profile: KeyProfile | None = None) -> DataFrame:
    """Texts of the previous and next eligible group, joined by " | ".

    ``groups``: page_id, group_no, text, eligible.
    """
    shown = F.when(F.col("eligible") & (F.col("text") != ""), F.col("text"))
    out = ordered(
        groups, ["page_id"], ["group_no"], {"_p": previous(shown), "_n": following(shown)}, profile
    )
    context = F.concat_ws(" | ", "_p", "_n")
    if cap > 0:
        keep = max(0, cap - 3)
        context = F.when(F.length(context) <= cap, context).otherwise(
            F.concat(F.substring(context, 1, keep), F.lit("..."))
        )
    return out.withColumn("context", context).drop("_p", "_n")


def watermark_flag(
    regions: DataFrame, height: int, width: int, scope: list[str] | None = None,
    keywords: tuple[str, ...] = K.WATERMARK_KEYWORDS, profile: KeyProfile | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Site marks: keyword, repeated text near its last place, domain or edge number.

    ``scope`` decides how far the memory of seen texts reaches: the page, or a
    chapter (then ``order`` must order its pages too).
    """
    scope = scope or ["page_id"]
    lower, compact = watermark_lower("source_text"), watermark_compact("source_text")
    keyed = regions.withColumns({
        "_key": watermark_key("source_text"), "_boxed": F.col("x1").isNotNull(),
        "_word": any_of([lower.contains(k.lower()) | compact.contains(k.lower()) for k in keywords]),
    })
    last = {f"_last_{c}": previous(F.col(c)) for c in ("x1", "y1", "x2", "y2")}
    seen = ordered(keyed, [*scope, "_key", "_boxed"], order or ["pos", "region_id"], last, profile)
    box, key = Box(), F.col("_key")
    repeat = F.coalesce(F.col("_boxed") & similar_pos(box, Box("_last_")), F.lit(False))
    domain = key.rlike(r"^[a-z0-9]{4,}(com|net|org)\z")
    number = key.rlike(f"^{K.NOT_WS}{{2,12}}\\p{{Nd}}{{1,4}}\\z")
    edge = F.coalesce(near_edge(box, F.lit(height), F.lit(width)) & number, F.lit(False))
    flag = F.col("_word") | repeat | domain | edge
    return seen.withColumns({
        "is_watermark": flag,
        "watermark_rule": F.when(F.col("_word"), "keyword").when(repeat, "repeat").when(domain, "domain").when(edge, "edge"),
    }).drop("_key", "_boxed", "_word", *last)


# ---------------------------------------------------------------------------
# interval generators
# ---------------------------------------------------------------------------

def _spans(pages: DataFrame, height: str, count: Column, start, end) -> DataFrame:
    """Rows i = 0.. until a span reaches the end; start/end are functions of i."""
    h = F.col(height)
    all_spans = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(0))), lambda i: F.struct(
        i.alias("index"), start(i).alias("start"), end(i).alias("end")
    ))
    kept = F.filter(all_spans, lambda s: (s["index"] == 0) | (end(s["index"] - 1) < h))
    return pages.withColumn("_span", F.explode(kept)).select(*pages.columns, "_span.*")


def tiles(pages: DataFrame, height: str = "height", rule: TileRule = TileRule()) -> DataFrame:
    """Overlapping padded tiles of tall pages: index, start, end."""
    h = F.col(height)
    ratio = min(0.5, max(0.15, rule.overlap_ratio))
    stride = rule.tile_height - int(rule.tile_height * ratio)
    pad = max(0, rule.edge_padding)

    def end(i: Column) -> Column:
        raw = F.least(i * stride + rule.tile_height, h)
        tail = F.when(h - raw < rule.min_tile_height, h).otherwise(raw)
        return F.least(h, tail + pad)

    tall = h > rule.tile_height * 1.5
    count = F.when(tall, F.floor((h - 1) / stride)).otherwise(F.lit(0))
    return _spans(
        pages, height, count, lambda i: F.when(tall, F.greatest(F.lit(0), i * stride - pad)).otherwise(F.lit(0)),
        lambda i: F.when(tall, end(i)).otherwise(h),
    )


def edge_tiles(pages: DataFrame, height: str = "height", rule: TileRule = TileRule()) -> DataFrame:
    """Top and bottom band of a page."""
    h = F.col(height)
    ratio = max(0.05, min(0.5, rule.edge_band_ratio))
    pad = max(0, rule.edge_padding)
    band = F.least(F.greatest(F.floor(h * F.lit(ratio)), F.lit(max(32, rule.edge_band_min_height))), h)
    bands = F.array(
        F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).cast("long").alias("start"), F.least(h, band + pad).cast("long").alias("end")),
        F.struct(F.lit(1).cast("long").alias("index"), F.greatest(F.lit(0), h - band - pad).cast("long").alias("start"), h.cast("long").alias("end")),
    )
    return pages.withColumn("_span", F.explode(bands)).select(*pages.columns, "_span.*")


def _overlapping(pages, height, size, overlap, threshold, absorb_equal: bool) -> DataFrame:
    if size <= overlap:
        raise ValueError("the span size must be greater than the overlap")
    h, stride = F.col(height), size - overlap
    tall = h > threshold

    def end(i: Column) -> Column:
        raw = F.least(i * stride + size, h)
        rest = h - raw
        absorb = (rest <= overlap) if absorb_equal else (rest < overlap)
        return F.when(~tall, h).when(absorb, h).otherwise(raw)

    count = F.when(tall, F.floor((h - 1) / stride)).otherwise(F.lit(0))
    return _spans(pages, height, count, lambda i: i * stride, end)


def slices(pages: DataFrame, size: int = 16000, overlap: int = 32, threshold: int = 16383, height: str = "height") -> DataFrame:
    """Storage slices of pages above the threshold; a tail up to the overlap is absorbed."""
    return _overlapping(pages, height, size, overlap, threshold, True)


def stripes(pages: DataFrame, size: int, overlap: int, threshold: int, height: str = "height") -> DataFrame:
    """Processing stripes; only a tail below the overlap is absorbed."""
    return _overlapping(pages, height, size, overlap, threshold, False)


def stripe_layout(
    spans: DataFrame, keys: list[str], overlap: int, scale: int = 1, profile: KeyProfile | None = None,
) -> DataFrame:
    """Rows of each scaled stripe that stay after trimming, and where they go."""
    size = (F.col("end") - F.col("start")) * scale
    out = ordered(
        spans.withColumn("_size", size), keys, ["index"],
        {"_next": following(F.col("index")), "_prev": previous(F.col("index"))}, profile,
    )
    trim = max(0, overlap)
    first = F.when(F.col("_prev").isNull(), 0).otherwise(trim)
    last = F.when(F.col("_next").isNull(), F.col("_size")).otherwise(F.col("_size") - trim)
    cut = out.withColumns({"keep_from": first.cast("long"), "keep_to": last.cast("long")})
    placed = ordered(
        cut.withColumn("_kept", F.col("keep_to") - F.col("keep_from")), keys, ["index"],
        {"_upto": running_sum(F.col("_kept"))}, profile,
    )
    return placed.withColumn("offset", (F.col("_upto") - F.col("_kept")).cast("long")).drop(
        "_size", "_next", "_prev", "_kept", "_upto"
    )


# ---------------------------------------------------------------------------
# batches, history, pace, budgets
# ---------------------------------------------------------------------------

def pack_by_count(df: DataFrame, keys: list[str], order: list[str], max_items: int, profile: KeyProfile | None = None) -> DataFrame:
    """Consecutive batches of a fixed size."""
    out = ordered(df, keys, order, {"_r": rank()}, profile)
    return out.withColumns({
        "batch_no": F.floor((F.col("_r") - 1) / max_items), "item_no": (F.col("_r") - 1) % max_items + 1,
    }).drop("_r")


def recent_history(visits: DataFrame, n: int, keys: list[str], time: str, tie: str) -> DataFrame:
    """Latest visit per chapter, then the newest ``n`` of those."""
    latest = visits.groupBy(*keys).agg(F.max(F.struct(time, tie)).alias("_v")).select(*keys, "_v.*")
    return latest.orderBy(F.desc(time), F.desc(tie)).limit(n)


def pace_audit(
    requests: DataFrame, rps: float, keys: list[str], time: str, tie: str, profile: KeyProfile | None = None,
) -> DataFrame:
    """Earliest allowed start of each request, and by how much it came too early.

    With requests numbered from 0, request i may start at
    max over j <= i of (time_j + (i - j) / rps).
    """
    step = 1.0 / max(float(rps), 0.001)
    numbered = ordered(requests, keys, [time, tie], {"_r": rank()}, profile)
    base = F.col(time) - (F.col("_r") - 1) * F.lit(step)
    out = ordered(numbered, keys, [time, tie], {"_m": running_max(base)}, profile)
    allowed = F.col("_m") + (F.col("_r") - 1) * F.lit(step)
    return out.withColumn("allowed_at", allowed).withColumn(
        "too_early", F.greatest(F.lit(0.0), F.col("allowed_at") - F.col(time))
    ).drop("_r", "_m")


def largest_in_group(regions: DataFrame, keys: list[str]) -> DataFrame:
    """The largest region of a group takes the reply; the rest is erased only.

    ``regions``: keys, region_id, pos, box, reply, skipped (not eligible),
    blank (stays empty instead of erased).  Groups are small (a speech balloon),
    and the best row comes from a map-side-combined aggregate.
    """
    area = Box().area
    best = regions.groupBy(*keys).agg(
        F.max_by("region_id", F.when(~F.col("skipped"), F.struct(area, -F.col("pos")))).alias("_best"),
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("skipped")).alias("_ok"),
        *[F.min(c).alias(f"render_{c}") for c in ("x1", "y1")],
        *[F.max(c).alias(f"render_{c}") for c in ("x2", "y2")],
    )
    j = regions.join(best, keys)
    mine = (F.col("region_id") == F.col("_best")) | (F.col("_n") == 1)
    target = (
        F.when(F.col("_n") == 1, F.col("reply"))
        .when(F.col("_ok") == 0, F.lit(""))
        .when(mine, F.col("reply")).when(F.col("blank"), F.lit("")).otherwise(K.ERASE_ONLY)
    )
    render = mine & (F.col("_n") > 1) & (F.col("_ok") > 0)
    boxes = {f"render_{c}": F.when(render, F.col(f"render_{c}")) for c in ("x1", "y1", "x2", "y2")}
    return j.withColumns({"target_text": target, **boxes}).drop("_best", "_n", "_ok")


def retry_budget(rows: DataFrame, wanted: Column, budget: int, key: str = "page_id", order: str = "pos") -> DataFrame:
    """The first ``budget`` rows per page that want a retry.

    A rank filter: Spark keeps at most ``budget`` rows per key before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(order)
    return rows.where(wanted).withColumn("retry_no", F.row_number().over(w)).where(F.col("retry_no") <= budget)


def newest_per_listener(events: DataFrame, n: int, listener: str, time: str, tie: str) -> DataFrame:
    """What a buffer that drops its oldest event still holds."""
    w = Window.partitionBy(listener).orderBy(F.desc(time), F.desc(tie))
    return events.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def stage_index(stage: Column) -> Column:
    out = F.lit(0)
    for name, index in K.STAGE_INDEX.items():
        out = F.when(stage == name, index).otherwise(out)
    return out


def dedupe_keep_order(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """First occurrence per key, by aggregation rather than a window."""
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")
