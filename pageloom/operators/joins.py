"""Joins between regions, pages, containers, reports and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.base import strip
from pageloom.functions.geometry import Box, band_height, intersection, overlap_width, scale_box
from pageloom.functions.noise import noise_reason
from pageloom.functions.text import levenshtein_ratio, normalize_for_compare
from pageloom.skew import KeyProfile, following, ordered, previous

CELL_X, CELL_Y = 256, 128


# ---------------------------------------------------------------------------
# range join
# ---------------------------------------------------------------------------

def _with_cells(df: DataFrame, box: tuple[str, str, str, str], cell: tuple[int, int]) -> DataFrame:
    x1, y1, x2, y2 = (F.col(c) for c in box)
    def span(low: Column, high: Column, size: int) -> Column:
        first = F.floor(low / size)
        return F.sequence(first, F.greatest(first, F.floor(high / size)))

    return df.withColumn("_cx", F.explode(span(x1, x2, cell[0]))).withColumn(
        "_cy", F.explode(span(y1, y2, cell[1]))
    )


def grid_join(
    left: DataFrame, right: DataFrame, keys: list[str],
    left_box: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"),
    right_box: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"),
    condition: Callable[[str, str], Column] | None = None,
    cell: tuple[int, int] = (CELL_X, CELL_Y),
) -> DataFrame:
    """Rows of both sides whose boxes touch, as columns under aliases a and b.

    Each box is listed in the grid cells it covers and the join is an equi-join
    on (keys, cell).  A pair is kept only in the cell of its common corner, so
    nothing has to be deduplicated, and a page of any size is spread over its
    cells.
    """
    a = _with_cells(left, left_box, cell).alias("a")
    b = _with_cells(right, right_box, cell).alias("b")
    lx1, ly1, lx2, ly2 = (F.col(f"a.{c}") for c in left_box)
    rx1, ry1, rx2, ry2 = (F.col(f"b.{c}") for c in right_box)
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_cx", "_cy"]]
    touch = (lx1 <= rx2) & (rx1 <= lx2) & (ly1 <= ry2) & (ry1 <= ly2)
    corner = (F.col("a._cx") == F.floor(F.greatest(lx1, rx1) / cell[0])) & (
        F.col("a._cy") == F.floor(F.greatest(ly1, ry1) / cell[1])
    )
    cond = touch & corner
    if condition is not None:
        cond = cond & condition("a", "b")
    for part in on:
        cond = cond & part
    return a.join(b, cond)


def candidate_pairs(
    regions: DataFrame, condition: Callable[[Box, Box], Column] | None = None,
    keys: list[str] | None = None, order: str = "pos",
    box: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2"), direct: KeyProfile | None = None,
) -> DataFrame:
    """Pairs of regions of one page that touch, the earlier one under alias a.

    ``direct`` profiles the keys: up to its limit all rows of a page are compared, which
    needs no cells and, where rows lie by page, no shuffle; larger pages take the grid.
    """
    keys = keys or ["page_id"]

    earlier = F.col(f"a.{order}") < F.col(f"b.{order}")
    rule = None if condition is None else condition(Box(alias="a"), Box(alias="b"))

    def grid(rows: DataFrame) -> DataFrame:
        return grid_join(rows, rows, keys, box, box, lambda a, b: earlier if rule is None else earlier & rule)

    if direct is None:
        return grid(regions)
    small, large = direct.split(regions)
    on = F.lit(True)
    # rows far apart from top to bottom, as most are, are told by two numbers
    for low, high in ((box[1], box[3]), (box[0], box[2])):
        on = on & (F.col(f"a.{low}") <= F.col(f"b.{high}")) & (F.col(f"b.{low}") <= F.col(f"a.{high}"))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = small.alias("a").hint("merge").join(small.alias("b"), on & earlier)
    if rule is not None:
        # not a filter: it would become part of the join's condition, where its code is too long to be compiled
        pairs = pairs.withColumn("_held", F.explode(F.when(rule, F.array(F.lit(True)))))
    if large is None:
        return pairs
    sides = [F.struct(*[F.col(f"{side}.{c}") for c in regions.columns]).alias(side) for side in ("a", "b")]
    return pairs.select(*sides).unionByName(grid(large).select(*sides))


# ---------------------------------------------------------------------------
# neighbours
# ---------------------------------------------------------------------------

def next_on_page(df: DataFrame, columns: list[str], profile: KeyProfile | None = None) -> DataFrame:
    """Columns of the next detected region, prefixed ``next_``."""
    scans = {f"next_{c}": following(F.col(c)) for c in columns}
    return ordered(df, ["page_id"], ["pos"], scans, profile)


def page_neighbours(
    pages: DataFrame, keys: list[str], number: str = "page_no", page: str = "page_id",
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Previous and next numbered page of the same chapter; gaps are allowed."""
    numbered = pages.where(F.col(number).isNotNull())
    scans = {"prev_page": previous(F.col(page)), "next_page": following(F.col(page))}
    return ordered(numbered, keys, [number, page], scans, profile)


def remap_to_page(local: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of a tile in page coordinates."""
    shifted = local.join(tiles, keys, "left")
    dx, dy = F.coalesce("x_offset", F.lit(0)), F.coalesce("y_offset", F.lit(0))
    return shifted.withColumns({
        "x1": (F.col("x1") + dx).cast("int"), "y1": (F.col("y1") + dy).cast("int"),
        "x2": (F.col("x2") + dx).cast("int"), "y2": (F.col("y2") + dy).cast("int"),
    }).drop("x_offset", "y_offset")


# ---------------------------------------------------------------------------
# page borders
# ---------------------------------------------------------------------------

def pair_id(x1: Column, y1: Column, text: Column) -> Column:
    """Stable id of a border pair: position in steps of five pixels and the text."""
    step = lambda v: F.floor(v / 5).cast("string")
    key = F.concat_ws("|", step(x1), step(y1), strip(F.lower(F.coalesce(text, F.lit("")))))
    return F.substring(F.md5(key), 1, 12)


def match_edge_bands(
    regions: DataFrame, neighbours: DataFrame, height: int, ratio: float = 0.15,
    min_overlap: float = 0.5,
) -> DataFrame:
    """Regions at a page border that continue on the neighbour page.

    ``neighbours`` has page_id, prev_page and next_page.  A bottom region gets
    all matching texts of the next page's top band; a top region that matches
    the previous page is taken over by it.  One row per matched region and role.
    """
    band = band_height(F.lit(height), ratio)
    noise = lambda top: noise_reason(
        "source_text", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), top,
        "confidence", band,
    ).isNull()
    cols = ["page_id", "region_id", "pos", "x1", "y1", "x2", "y2", "source_text"]
    kept = regions.where(F.col("x1").isNotNull())
    bottom_all = kept.where(F.col("y1") >= height - band).withColumn(
        "clean", noise(F.col("y1") - (height - band))
    ).select(*cols, "clean", (F.col("y2") - height).alias("edge_y"))
    top_all = kept.where(F.col("y2") <= band).withColumn("clean", noise(F.col("y1"))).select(
        *cols, "clean", F.col("y1").alias("edge_y")
    )
    following_page = neighbours.where("next_page IS NOT NULL").select("page_id", "next_page")
    bottom = bottom_all.join(following_page, "page_id")
    # the vertical gap may be up to a quarter band: a touching test on padded boxes
    gap = F.greatest(F.lit(5), F.floor(band / 4))
    left = bottom.withColumns({"_ly1": F.col("edge_y") - gap, "_ly2": F.col("edge_y") + gap}).withColumn(
        "_page", F.col("next_page")
    )
    right = top_all.withColumns({"_ly1": F.col("edge_y"), "_ly2": F.col("edge_y"), "_page": F.col("page_id")})

    def cond(a: str, b: str) -> Column:
        l, r = Box(alias=a), Box(alias=b)
        ix = overlap_width(l, r)
        enough = ix / F.greatest(F.least(l.width, r.width), F.lit(1)) >= min_overlap
        return (ix > 0) & enough

    box = ("x1", "_ly1", "x2", "_ly2")
    pairs = grid_join(left, right, ["_page"], box, box, cond, (CELL_X, 64)).select(
        F.col("a.page_id").alias("page_id"), F.col("a.region_id").alias("bottom_id"),
        F.col("a.clean").alias("bottom_clean"),
        F.col("b.page_id").alias("next_page"), F.col("b.region_id").alias("top_id"),
        F.col("b.pos").alias("top_pos"), F.col("b.source_text").alias("top_text"),
        F.col("b.clean").alias("top_clean"),
        pair_id(F.col("b.x1"), F.col("b.edge_y"), F.col("b.source_text")).alias("pair_id"),
    )
    as_bottom = pairs.where("top_clean").groupBy("page_id", F.col("bottom_id").alias("region_id")).agg(
        F.min_by("pair_id", F.struct("top_pos", "top_id")).alias("pair_id"),
        F.array_sort(F.collect_list(F.struct("top_pos", "top_id", "top_text"))).alias("t"),
    ).select(
        "page_id", "region_id", F.lit("current_bottom").alias("role"), "pair_id",
        F.filter(F.col("t.top_text"), lambda s: s != "").alias("crosspage_texts"),
    )
    as_top = pairs.where("bottom_clean").groupBy(
        F.col("next_page").alias("page_id"), F.col("top_id").alias("region_id")
    ).agg(F.first("pair_id").alias("pair_id")).select(
        "page_id", "region_id", F.lit("next_top").alias("role"), "pair_id",
        F.lit(None).cast("array<string>").alias("crosspage_texts"),
    )
    return as_bottom.unionByName(as_top)


def edge_group_candidates(bottom: DataFrame, top: DataFrame, min_overlap: float = 0.2) -> DataFrame:
    """Bottom groups and top groups of the next page that overlap enough in x.

    Both inputs: page_id (the upper page of the pair), group_id, x1, x2.
    """
    def strip_rows(df: DataFrame) -> DataFrame:
        return df.withColumns({"_t": F.lit(0), "_u": F.lit(0)})

    def score(a: str, b: str) -> Column:
        l, r = Box(alias=a), Box(alias=b)
        return F.greatest(overlap_width(l, r), F.lit(0)) / F.least(l.width, r.width)

    def cond(a: str, b: str) -> Column:
        l, r = Box(alias=a), Box(alias=b)
        return (F.least(l.width, r.width) > 0) & (score(a, b) >= min_overlap)

    box = ("x1", "_t", "x2", "_u")
    return grid_join(strip_rows(bottom), strip_rows(top), ["page_id"], box, box, cond).select(
        F.col("a.page_id").alias("page_id"), F.col("a.group_id").alias("bottom_group"),
        F.col("b.group_id").alias("top_group"), score("a", "b").alias("overlap"),
    )


# ---------------------------------------------------------------------------
# best-match joins
# ---------------------------------------------------------------------------

def assign_container(
    regions: DataFrame, containers: DataFrame, min_overlap: float = 0.35, min_area: float = 1.6,
    relaxed_overlap: float = 0.18, relaxed_area: float = 0.9,
) -> DataFrame:
    """Container of each region: largest share of the region, then smallest box.

    Pages on which nothing passes the strict thresholds use the relaxed ones.
    Result: page_id, region_id, container_id, overlap, relaxed (matched regions only).
    """
    r, c = Box(alias="a"), Box(alias="b")
    region_area = F.greatest(F.lit(1), r.area)
    box_area = F.greatest(F.lit(1), c.area)
    share = intersection(r, c) / region_area

    def cond(_a: str, _b: str) -> Column:
        return (intersection(r, c) > 0) & (share >= relaxed_overlap) & (
            box_area >= region_area * F.lit(relaxed_area)
        )

    pairs = grid_join(regions, containers, ["page_id"], condition=cond).select(
        F.col("a.page_id").alias("page_id"), F.col("a.region_id").alias("region_id"),
        F.struct((-share).alias("neg"), box_area.alias("area"), F.col("b.container_id").alias("id")).alias("fit"),
        ((share >= min_overlap) & (box_area >= region_area * F.lit(min_area))).alias("strict"),
    )
    best = pairs.groupBy("page_id", "region_id").agg(
        F.min(F.when(F.col("strict"), F.col("fit"))).alias("strict_fit"),
        F.min("fit").alias("any_fit"),
    )
    pages = best.groupBy("page_id").agg(F.bool_or(F.col("strict_fit").isNotNull()).alias("has_strict"))
    chosen = best.join(pages, "page_id").withColumn(
        "fit", F.when(F.col("has_strict"), F.col("strict_fit")).otherwise(F.col("any_fit"))
    )
    return chosen.where("fit IS NOT NULL").select(
        "page_id", "region_id", F.col("fit.id").alias("container_id"),
        (-F.col("fit.neg")).alias("overlap"), (~F.col("has_strict")).alias("relaxed"),
    )


def assign_component(components: DataFrame, regions: DataFrame, min_share: float = 0.02) -> DataFrame:
    """Region with the largest intersection per component, or null below the share."""
    c, r = Box(alias="a"), Box(alias="b")
    pairs = grid_join(
        components, regions, ["page_id"], condition=lambda a, b: intersection(c, r) > 0
    ).select(
        F.col("a.page_id").alias("page_id"), F.col("a.component_id").alias("component_id"),
        F.struct((-intersection(c, r)).alias("neg"), F.col("b.pos").alias("pos"), F.col("b.region_id").alias("id")).alias("fit"),
        F.greatest(F.lit(1), c.area).alias("area"),
    )
    best = pairs.groupBy("page_id", "component_id").agg(
        F.min("fit").alias("fit"), F.first("area").alias("area")
    ).where(-F.col("fit.neg") / F.col("area") >= min_share).select(
        "page_id", "component_id", F.col("fit.id").alias("region_id")
    )
    return components.select("page_id", "component_id").join(best, ["page_id", "component_id"], "left")


def latest_per_key(df: DataFrame, keys: list[str], time: str, tie: str, columns: list[str]) -> DataFrame:
    """Newest row per key; equal times go to the larger tie value."""
    newest = F.max_by(F.struct(*columns), F.struct(time, tie)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def latest_report_per_page(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """Every page with its newest report, if any."""
    newest = latest_per_key(reports, ["page_id"], "mtime", "report_id", ["report_id", "mtime"])
    return pages.join(newest, "page_id", "left")


# ---------------------------------------------------------------------------
# carried texts
# ---------------------------------------------------------------------------

def consume_carryover(rows: DataFrame, carried: DataFrame, order: str = "region_id") -> DataFrame:
    """Give each carried text to the first waiting row of its pair.

    ``rows``: region_id, pair_id; ``carried``: pair_id, bottom_text, created_at.
    Rows that get nothing are translated themselves (``translate`` is true).
    """
    newest = carried.groupBy("pair_id").agg(F.max_by("bottom_text", "created_at").alias("carried_text"))
    first = rows.where("pair_id IS NOT NULL").groupBy("pair_id").agg(F.min(order).alias("_first"))
    takers = first.join(newest, "pair_id").select(
        F.col("_first").alias(order), F.col("pair_id").alias("_pair"), "carried_text"
    )
    out = rows.join(takers, order, "left").drop("_pair")
    return out.withColumn("translate", F.coalesce(F.col("carried_text") == "", F.lit(True)))


def unconsumed_carryover(rows: DataFrame, carried: DataFrame) -> DataFrame:
    return carried.join(rows.select("pair_id"), "pair_id", "left_anti")


# ---------------------------------------------------------------------------
# evaluation joins
# ---------------------------------------------------------------------------

def consistency_join(
    original: DataFrame, second: DataFrame, scale_x: float, scale_y: float, width: int,
    height: int, min_box: int = 4, threshold: float = 0.85, normalize: bool = True,
) -> DataFrame:
    """Original readings against a second reading of the scaled boxes.

    One row per original region: ``skip`` names why it was left out, else
    ``similarity`` and ``match`` are filled.
    """
    box = scale_box(Box(), F.lit(scale_x), F.lit(scale_y), F.lit(width), F.lit(height))
    text = strip(F.coalesce("source_text", F.lit("")))
    staged = original.withColumns({"_box": box, "_text": text})
    small = F.col("_box").isNull() | (F.col("_box.x2") - F.col("_box.x1") < min_box) | (
        F.col("_box.y2") - F.col("_box.y1") < min_box
    )
    skip = F.when(F.col("x1").isNull(), "no_box").when(F.col("_text") == "", "empty_text").when(small, "too_small")
    # a region lies on one page: with it as a key, rows that lie by page are not shuffled
    keys = [k for k in ("page_id", "region_id") if k in second.columns]
    rows = staged.withColumn("skip", skip).join(
        second.select(*keys, F.col("source_text").alias("second_text")), keys, "left"
    )
    rows = rows.withColumn("up_text", strip(F.coalesce("second_text", F.lit(""))))
    a, b = F.col("_text"), F.col("up_text")
    if normalize:
        a, b = normalize_for_compare(a), normalize_for_compare(b)
    # columns of their own: the ratio names either side several times
    rows = rows.withColumns({"_a": a, "_b": b})
    similarity = F.when(F.col("skip").isNull(), levenshtein_ratio("_a", "_b"))
    return rows.withColumn("similarity", similarity).select(
        "region_id", "skip", F.col("_text").alias("orig_text"), "up_text",
        "similarity", (F.col("similarity") >= threshold).alias("match"),
    )


def source_stat_join(chapters: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Download counts per chapter: the manifest first, else the files found.

    ``manifests``: chapter_id, ok_count, total (null total = unreadable);
    ``files``: chapter_id, images.
    """
    j = chapters.join(manifests, "chapter_id", "left").join(files, "chapter_id", "left")
    images = F.coalesce("images", F.lit(0).cast("long"))
    done = F.coalesce(F.when(F.col("total").isNotNull(), F.col("ok_count")), images)
    total = F.coalesce("total", images)
    return j.select(
        *chapters.columns, (done > 0).alias("downloaded"), done.alias("downloaded_count"),
        total.alias("downloaded_total"),
    )


def translated_pages(pages: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that have an output."""
    return pages.join(outputs.select(*keys), keys, "left_semi")


def run_compare(base: DataFrame, candidate: DataFrame, goals: dict[str, float] | None = None) -> DataFrame:
    """Metric change between two runs; a goal is the wanted relative fall."""
    j = base.select("workload", "metric", F.col("value").alias("base_value")).join(
        candidate.select("workload", "metric", F.col("value").alias("new_value")), ["workload", "metric"]
    )
    change = F.when(F.col("base_value") > 0, (F.col("new_value") - F.col("base_value")) / F.col("base_value")).otherwise(F.lit(0.0))
    out = j.withColumn("change", change)
    if goals:
        goal = F.lit(None).cast("double")
        for metric, fall in goals.items():
            goal = F.when(F.col("metric") == metric, F.lit(fall)).otherwise(goal)
        out = out.withColumn("met", F.when(goal.isNotNull(), F.col("change") <= -goal))
    return out


def uncached(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages whose content key is not in the result table yet.

    ``pages``: path, lang, size, mtime_ns; ``cache``: cache_key.
    """
    keyed = pages.withColumn("cache_key", cache_key("path", "lang", "size", "mtime_ns"))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def cache_key(path: str, lang: str, size: str, mtime_ns: str) -> Column:
    stat = F.when(
        F.col(size).isNull() | F.col(mtime_ns).isNull(), F.lit("missing")
    ).otherwise(F.concat_ws(":", F.col(size).cast("string"), F.col(mtime_ns).cast("string")))
    return F.sha1(F.concat_ws(":", F.col(path), F.col(lang), stat, F.lit("v1")))


def cacheable(results: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Result rows worth storing; pages without regions are not by default."""
    return results if keep_empty else results.where(F.size("regions") > 0)


def drop_keys(df: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Rows left after removing whole keys."""
    return df.join(dropped.select(*keys), keys, "left_anti")


def missing_keys(dropped: DataFrame, tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys to drop that no table knows ("not found")."""
    left = dropped.select(*keys)
    for t in tables:
        left = left.join(t.select(*keys), keys, "left_anti")
    return left


def skip_existing(items: DataFrame, files: DataFrame) -> DataFrame:
    """Download items whose file is missing or empty."""
    return items.join(files.where(F.col("length") > 0).select("path"), "path", "left_anti")
