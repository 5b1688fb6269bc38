"""Merging of lines, paragraphs and chunks that needs only neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.geometry import Box, band_height, mask_params, overlap_width
from pageloom.functions.script import script_type
from pageloom.skew import (
    KeyProfile, following, max_before, ordered, previous, running_sum,
)


def merge_group(regions: DataFrame, keys: list[str], ties: tuple[str, ...] = ("y1", "pos")) -> DataFrame:
    """One row per group: texts from left to right, union box, mean confidence."""
    texts = F.array_sort(F.collect_list(F.struct("x1", *ties, "source_text")))
    return regions.groupBy(*keys).agg(
        texts.alias("_texts"), F.min("x1").alias("x1"), F.min("y1").alias("y1"),
        F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.avg("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("members"), F.min("region_id").alias("first_id"),
    ).withColumn(
        "source_text",
        F.concat_ws(" ", F.filter(F.col("_texts.source_text"), lambda s: s != "")),
    ).drop("_texts")


def merge_paragraphs(
    regions: DataFrame, y_gap_ratio: float = 3.0, min_x_overlap: float = 0.15,
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Lines joined to paragraphs by comparing each with the line above it."""
    order = ["y1", "x1", "pos"]
    boxes = {f"last_{c}": previous(F.col(c)) for c in ("x1", "y1", "x2", "y2")}
    lined = ordered(regions.where("x1 IS NOT NULL"), ["page_id"], order, boxes, profile)
    cur, last = Box(), Box("last_")
    gap = cur.y1 - last.y2
    mean_h = (last.height + cur.height) / 2
    share = F.greatest(F.lit(0), overlap_width(last, cur)) / F.greatest(F.least(last.width, cur.width), F.lit(1))
    close = (gap < mean_h * y_gap_ratio) & (gap > -mean_h * 0.5) & (share > min_x_overlap)
    flagged = lined.withColumn("_break", F.when(F.coalesce(close, F.lit(False)), 0).otherwise(1))
    grouped = ordered(flagged, ["page_id"], order, {"paragraph": running_sum(F.col("_break"))}, profile)
    return merge_group(grouped, ["page_id", "paragraph"])


def merge_to_chunks(boxes: DataFrame, gap: int = 100, max_height: int = 2048, profile: KeyProfile | None = None) -> DataFrame:
    """Vertical islands of boxes; islands taller than the limit are cut with overlap.

    Comparing with the largest end of *all* earlier boxes finds the same breaks
    as comparing with the end of the current island.
    """
    order = ["y1", "pos"]
    seen = ordered(boxes, ["page_id"], order, {"_end": max_before(F.col("y2"))}, profile)
    flagged = seen.withColumn(
        "_break", F.when(F.coalesce(F.col("y1") - F.col("_end") < gap, F.lit(False)), 0).otherwise(1)
    )
    grouped = ordered(flagged, ["page_id"], order, {"_island": running_sum(F.col("_break"))}, profile)
    islands = grouped.groupBy("page_id", "_island").agg(
        F.min("y1").alias("top"), F.max("y2").alias("bottom"), F.min("x1").alias("x1"), F.max("x2").alias("x2")
    )
    tall = F.col("bottom") - F.col("top") > max_height
    starts = F.when(
        tall, F.sequence(F.col("top"), F.col("bottom") - 1, F.lit(max_height - 100))
    ).otherwise(F.array("top"))
    return islands.withColumn("y1", F.explode(starts)).select(
        "page_id", "y1", F.when(tall, F.least(F.col("y1") + max_height, F.col("bottom"))).otherwise(F.col("bottom")).alias("y2"),
        "x1", "x2",
    )


def vertical_gap_fill(
    regions: DataFrame, height: int, width: int, max_gap: int, expand: int = 10, dilation: int = 4,
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Rectangles between successive boxes of one paragraph."""
    kept = regions.where(
        F.col("x1").isNotNull() & ~F.coalesce(F.col("target_text").startswith("[SFX:"), F.lit(False))
    )
    grow = mask_params(Box(), "target_text", "is_sfx", expand, dilation)["expand"]
    grown = kept.withColumn("_g", grow).select(
        "page_id", "pos",
        F.greatest(F.lit(0), F.col("x1") - F.col("_g")).alias("x1"),
        F.greatest(F.lit(0), F.col("y1") - F.col("_g")).alias("y1"),
        F.least(F.lit(width), F.col("x2") + F.col("_g")).alias("x2"),
        F.least(F.lit(height), F.col("y2") + F.col("_g")).alias("y2"),
    )
    nexts = {f"next_{c}": following(F.col(c)) for c in ("x1", "y1", "x2", "y2")}
    j = ordered(grown, ["page_id"], ["y1", "pos"], nexts, profile)
    cur, nxt = Box(), Box("next_")
    gap = nxt.y1 - cur.y2
    fill = (gap > 0) & (gap < max_gap) & (overlap_width(cur, nxt) > F.least(cur.width, nxt.width) * 0.5)
    return j.where(fill).select(
        "page_id", "pos", F.greatest(F.lit(0), F.least(cur.x1, nxt.x1) - 10).alias("fill_x1"),
        cur.y2.alias("fill_y1"), F.least(F.lit(width), F.greatest(cur.x2, nxt.x2) + 10).alias("fill_x2"),
        nxt.y1.alias("fill_y2"),
    )


def merge_same_line(
    regions: DataFrame, max_gap_ratio: float = 0.6, min_y_overlap: float = 0.7,
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Join neighbours of one line into a growing box.

    A row can only join the box before it when it starts right of the previous
    row, below no gap, and in the same script.  Those tests need neighbours
    only and cut a page into runs; within a run x grows, so a run is at most as
    long as the page is wide.  The growing comparison is a fold over the run.
    """
    order = ["y1", "x1", "pos"]
    kept = regions.where((F.col("source_text") != "") & F.col("x1").isNotNull()).withColumn(
        "_script", script_type("source_text")
    )
    scans = {
        "_px2": previous(F.col("x2")), "_pscript": previous(F.col("_script")),
        "_below": max_before(F.col("y2")),
    }
    lined = ordered(kept, ["page_id"], order, scans, profile)
    may_join = (F.col("x1") >= F.col("_px2")) & (F.col("_script") == F.col("_pscript")) & (F.col("y1") < F.col("_below"))
    flagged = lined.withColumn("_break", F.when(F.coalesce(may_join, F.lit(False)), 0).otherwise(1))
    runs = ordered(flagged, ["page_id"], order, {"_run": running_sum(F.col("_break"))}, profile)
    item = F.struct("y1", "x1", "pos", "x2", "y2", "region_id", "source_text", "confidence", "_script")
    packed = runs.groupBy("page_id", "_run").agg(F.array_sort(F.collect_list(item)).alias("_items"))

    def as_box(s: Column) -> Column:
        return F.struct(
            s["x1"].alias("x1"), s["y1"].alias("y1"), s["x2"].alias("x2"), s["y2"].alias("y2"),
            s["source_text"].alias("source_text"), s["confidence"].alias("confidence"),
            s["region_id"].alias("region_id"), s["_script"].alias("script"), F.lit(1).alias("members"),
        )

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        low, high = F.greatest(last["y1"], s["y1"]), F.least(last["y2"], s["y2"])
        h1, h2 = last["y2"] - last["y1"], s["y2"] - s["y1"]
        gap = s["x1"] - last["x2"]
        joins = (high > low) & ((high - low) / F.greatest(F.least(h1, h2), F.lit(1)) >= min_y_overlap) & (
            gap >= 0
        ) & (gap <= F.greatest(h1, h2) * F.lit(max_gap_ratio)) & (last["script"] == s["_script"])
        glue = F.when(last["script"].isin("ko", "cn", "jp"), "").otherwise(" ")
        grown = F.struct(
            F.least(last["x1"], s["x1"]).alias("x1"), F.least(last["y1"], s["y1"]).alias("y1"),
            F.greatest(last["x2"], s["x2"]).alias("x2"), F.greatest(last["y2"], s["y2"]).alias("y2"),
            F.concat(last["source_text"], glue, s["source_text"]).alias("source_text"),
            F.least(last["confidence"], s["confidence"]).alias("confidence"),
            last["region_id"].alias("region_id"), last["script"].alias("script"),
            (last["members"] + 1).alias("members"),
        )
        return F.when(
            joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        ).otherwise(F.concat(acc, F.array(as_box(s))))

    one = F.size("_items") == 1
    folded = F.when(one, F.array(as_box(F.element_at("_items", 1)))).otherwise(
        F.aggregate(
            F.slice("_items", 2, F.greatest(F.size("_items") - 1, F.lit(0))),
            F.array(as_box(F.element_at("_items", 1))), step,
        )
    )
    return packed.withColumn("_m", F.explode(folded)).select(
        "page_id", "_m.region_id", "_m.x1", "_m.y1", "_m.x2", "_m.y2", "_m.source_text",
        "_m.confidence", "_m.members",
    )


# ---------------------------------------------------------------------------
# groups that need a second reading
# ---------------------------------------------------------------------------

def line_count(members: Column, median_height: Column, ratio: float = 0.6) -> Column:
    """Text rows of a group: ``members`` is an ordered array of vertical centres."""
    def step(rows: Column, y: Column) -> Column:
        hit = F.array_position(F.transform(rows, lambda r: F.abs(y - r) <= median_height * ratio), F.lit(True))
        return F.when(hit == 0, F.concat(rows, F.array(y))).otherwise(
            F.transform(rows, lambda r, i: F.when(i + 1 == hit, (r + y) / 2).otherwise(r))
        )

    counted = F.size(F.aggregate(members, F.array().cast("array<double>"), step))
    return F.when(F.size(members) <= 1, F.size(members)).when(
        median_height <= 0, F.size(members)
    ).otherwise(counted)


def group_facts(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Row count, mean confidence and union box per group."""
    center = (F.col("y1") + F.col("y2")) / 2
    agg = regions.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("y1", "x1", "pos", center.alias("cy")))).alias("_rows"),
        F.median(F.col("y2") - F.col("y1")).alias("_median"), F.avg("confidence").alias("confidence"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.bool_or(F.col("edge_role").isNotNull()).alias("_edge"),
    )
    return agg.withColumn("lines", line_count(F.col("_rows.cy"), F.col("_median"))).drop("_rows", "_median")


def needs_second_reading(facts: DataFrame, height: int | None, low_confidence: float = 0.6) -> DataFrame:
    """At least two of: several lines, low confidence, at the page border."""
    edge = F.col("_edge")
    if height:
        band = band_height(F.lit(height), 0.12)
        edge = edge | (F.col("y1") <= band) | (F.col("y2") >= F.lit(height) - band)
    score = (F.col("lines") >= 2).cast("int") + (F.col("confidence") < low_confidence).cast("int") + edge.cast("int")
    return facts.withColumn("read_again", score >= 2)


def second_reading_requests(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Union boxes of the groups to read again."""
    return facts.where("read_again").select(*keys, "x1", "y1", "x2", "y2")


def rescan_flag(pages: DataFrame, regions: DataFrame, min_regions: int = 4, min_confidence: float = 0.6) -> DataFrame:
    """Pages with few or unsure regions should be read again at a larger scale.

    The mean is rounded, so that the order of summation does not decide at the limit.
    """
    facts = regions.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n"), F.round(F.avg("confidence"), 9).alias("_c"))
    few = F.coalesce("_n", F.lit(0)) < min_regions
    return pages.select("page_id").join(facts, "page_id", "left").select(
        "page_id", (few | (F.coalesce("_c", F.lit(0.5)) < min_confidence)).alias("rescan")
    )


