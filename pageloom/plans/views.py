"""Derived page tables over the given parquet tables.

``regions``      one row per detected text box
``progress``     stage events of tasks
``stage_metrics``, ``outputs``, ``downloads``  facts per page
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.constants import ERASE_ONLY, FAILURE_MARKER
from pageloom.skew import ROWS_COMPARED, KeyProfile, ordered, profile_keys, rank

PAGE_WIDTH, PAGE_HEIGHT = 800, 2000
PAGES_PER_CHAPTER, CHAPTERS_PER_SERIES = 12, 10
# distance of the region ids of two pages; a page above it ends the query with an error
ROWS_PER_PAGE = 100_000_000
# characters of all snippets up to which they are sent to every task
SNIPPETS_SENT = 16_000_000

_PROFILES: dict[tuple, KeyProfile] = {}


class Tables:
    """Lazy access to the tables of one data folder and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for heavy per-row work.

        A file of one row group is one task; where there are fewer splits than
        half the cores, rows are dealt out.  Larger tables are left alone.
        """
        df = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def profile(self, name: str, df: DataFrame, keys: list[str], **options) -> KeyProfile:
        """Group sizes, measured once per session and folder."""
        key = (self.spark.sparkContext.applicationId, self.folder, name, *keys)
        if key not in _PROFILES:
            _PROFILES[key] = profile_keys(df, keys, **options)
        return _PROFILES[key]

    # -- regions -----------------------------------------------------------
    @cached_property
    def _paged_lines(self) -> DataFrame:
        return self.table("lineitem").select(
            F.floor(F.col("l_orderkey") / 8).cast("long").alias("page_id"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice",
        )

    @cached_property
    def page_profile(self) -> KeyProfile:
        return self.profile("lineitem", self._paged_lines, ["page_id"])

    @cached_property
    def lines(self) -> DataFrame:
        """Boxes without texts; ``pos`` is the detection order on the page."""
        return self._boxes(self._paged_lines)

    @cached_property
    def direct_profile(self) -> KeyProfile:
        """Pages too large to compare all of their rows with each other."""
        return self.profile("direct", self._paged_lines, ["page_id"], limit=ROWS_COMPARED)

    def _boxes(self, paged: DataFrame, *more: str) -> DataFrame:
        """Ranked boxes of paged lines, and columns of theirs that go along."""
        order = [
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice",
        ]
        q = ordered(paged, ["page_id"], order, {"pos": rank()}, self.page_profile)
        region_id = F.when(F.col("pos") < ROWS_PER_PAGE, F.col("page_id") * ROWS_PER_PAGE + F.col("pos")).otherwise(
            F.raise_error("a page has too many regions for its ids").cast("long")
        )
        x1 = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 53) % 600
        y1 = (F.col("l_suppkey") * 29 + F.col("l_linenumber") * 17) % 1800
        return q.select(
            "page_id", region_id.alias("region_id"), "pos",
            x1.cast("int").alias("x1"), y1.cast("int").alias("y1"),
            (x1 + 20 + F.col("l_quantity").cast("long") * 4).cast("int").alias("x2"),
            (y1 + 12 + F.col("l_partkey") % 40).cast("int").alias("y2"),
            (((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 100).cast("double") / 100.0).alias("confidence"),
            "l_partkey", "l_suppkey", "l_linenumber", *more,
        )

    @cached_property
    def _snippets(self) -> tuple[DataFrame, int | None, bool]:
        """Beginnings of texts that lines show, the divisor that leads a line to its document,
        and whether no two documents share an id.  Where they are few they are sent to all lines."""
        docs = self.table("documents")
        row = docs.agg(
            (F.max("doc_id") + 1).alias("n"), (F.count("doc_id") == F.count_distinct("doc_id")).alias("single"),
            F.count(F.lit(1)).alias("rows"),
        ).first()
        # a line shows nothing behind this place of a text
        shown = self._paged_lines.agg(F.max("l_linenumber").alias("last"), F.min("l_suppkey").alias("least")).first()
        reach = 23 + 3 * max(0, shown["last"] or 0)
        short = (shown["least"] or 0) >= 0 and reach < 2**31
        snippets = docs.select("doc_id", F.substring("text", 1, reach).alias("text") if short else "text")
        if short and row["rows"] * reach <= SNIPPETS_SENT:
            snippets = F.broadcast(snippets)
        return snippets, row["n"], row["single"]

    @cached_property
    def _source_text(self) -> Column:
        """What a line shows, of the text of its document or fixed."""
        fixed = {
            0: "BOOM!", 1: "NEWTOKI 95", 2: "12 34", 3: "쾅!", 4: "A1_$", 5: "안녕 하세요",
            6: "...", 7: "site.com",
        }
        kind = F.col("l_partkey") % 23
        source = F.substring(
            "text", (1 + F.col("l_suppkey") % 20).cast("int"), (4 + F.col("l_linenumber") * 3).cast("int")
        )
        for value, text in reversed(fixed.items()):
            source = F.when(kind == value, text).otherwise(source)
        return source

    @cached_property
    def regions(self) -> DataFrame:
        """The core table: box, texts and confidence of every region.

        Where no two documents share an id, texts are cut and joined to the lines before
        these are ranked, so that the ranked rows lie by page and what follows per page
        needs no further shuffle.  Only the beginnings of texts that lines show are moved,
        and sent to all lines where they are few.
        """
        snippets, n, single = self._snippets
        if not single:
            return self.with_texts(self.lines)
        # lines without a document keep their place in the order and go after it
        texts = snippets.withColumn("_found", F.lit(True))
        paged = self._paged_lines.withColumn("doc_id", F.col("l_partkey") % n).join(texts, "doc_id", "left").select(
            *self._paged_lines.columns, self._source_text.alias("source_text"), "_found"
        )
        return self._shown(self._boxes(paged, "source_text", "_found").where("_found"))

    def with_texts(self, lines: DataFrame) -> DataFrame:
        """The rows of ``regions`` that belong to these rows of ``lines``.

        A query that needs few of the lines picks them before their texts are joined.
        """
        snippets, n, _ = self._snippets
        joined = lines.withColumn("doc_id", F.col("l_partkey") % n).join(snippets, "doc_id")
        return self._shown(joined.withColumn("source_text", self._source_text))

    def _shown(self, joined: DataFrame) -> DataFrame:
        which = F.col("l_suppkey") % 11
        target = (
            F.when(which == 0, FAILURE_MARKER).when(which == 1, ERASE_ONLY).when(which == 2, "")
            .when(which == 3, "쾅 소리").when(which == 4, "translate: output only, numbered")
            .when(which == 5, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("你好，第"), F.col("l_linenumber").cast("string"), F.lit("页。")))
        )
        return joined.select(
            "page_id", "region_id", "pos", "x1", "y1", "x2", "y2", "confidence", "source_text", target.alias("target_text"),
        )

    # -- facts per page ------------------------------------------------------
    @cached_property
    def page_facts(self) -> DataFrame:
        """Page hierarchy with deterministic run facts.

        One row per page of the line table; sums of integers keep every engine equal.
        """
        q = F.col("l_quantity").cast("long")
        facts = self._paged_lines.groupBy("page_id").agg(
            (10 * F.sum(q)).alias("ocr_ms"),
            (7 * F.sum(q) + 3 * F.sum(F.col("l_suppkey") % 50)).alias("translator_ms"),
            (5 * F.sum(F.col("l_partkey") % 30)).alias("inpainter_ms"),
            (2 * F.sum(F.col("l_linenumber").cast("long"))).alias("renderer_ms"),
            F.count(F.lit(1)).alias("regions"),
        )
        chapter = F.floor(F.col("page_id") / PAGES_PER_CHAPTER)
        return facts.select(
            "page_id", chapter.cast("long").alias("chapter_id"),
            F.floor(chapter / CHAPTERS_PER_SERIES).cast("long").alias("series_id"),
            (F.col("page_id") % PAGES_PER_CHAPTER + 1).alias("page_no"),
            "ocr_ms", "translator_ms", "inpainter_ms", "renderer_ms", "regions",
            (F.col("page_id") % 7 != 0).alias("ok"),
            (F.col("page_id") % 5 != 0).alias("has_output"),
        )

    # -- events -----------------------------------------------------------------
    @cached_property
    def progress(self) -> DataFrame:
        kind = F.col("event_type")
        stage = (
            F.when(kind == "click", "ocr").when(kind == "view", "translator")
            .when(kind == "signup", "renderer").when(kind == "purchase", "complete")
            .otherwise("failed")
        )
        return self.table("events").select(
            "event_id", "ts", F.col("user_id").cast("string").alias("task_id"),
            (F.col("user_id") % 12).cast("long").alias("chapter_id"), stage.alias("stage"),
            "value",
        )


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, F.col(ts))


def add_hierarchy(df: DataFrame) -> DataFrame:
    """chapter_id, series_id and page_no from page_id."""
    chapter = F.floor(F.col("page_id") / PAGES_PER_CHAPTER)
    return df.withColumns({
        "chapter_id": chapter.cast("long"),
        "series_id": F.floor(chapter / CHAPTERS_PER_SERIES).cast("long"),
        "page_no": F.col("page_id") % PAGES_PER_CHAPTER + 1,
    })
