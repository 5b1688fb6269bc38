"""JSON documents, logs, image folders and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.constants import IMAGE_EXTENSIONS
from pageloom.functions.text import natural_number, source_slug

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
REGION = (
    f"region_id:string,source_text:string,target_text:string,confidence:double,box_2d:{BOX},edge_role:string,"
    f"edge_box_2d:{BOX},skip_translation:boolean,is_watermark:boolean,inpaint_mode:string,crosspage_texts:array<string>,"
    "crosspage_pair_id:string,crosspage_role:string,quality_score:double,quality_signals:map<string,double>,"
    "recommendations:array<string>"
)
REPORT = (
    "task_id string, image_path string, output_path string, success boolean, error_code string, error_message string, "
    "target_language string, timings_ms map<string,double>, translator_counters map<string,bigint>, queue_wait_ms double, "
    "run_config map<string,string>, process struct<cpu_user_s:double,cpu_system_s:double,max_rss_mb:double>, "
    f"regions array<struct<{REGION}>>"
)
MANIFEST = (
    "manga_id string, chapter_id string, created_at string, "
    "pages array<struct<index:int,url:string,path:string,ok:boolean,error:string>>"
)
SLICES = (
    "version int, original_width int, original_height int, slice_height int, overlap int, "
    "slices array<struct<file:string,y:int,height:int>>"
)
CARRYOVER = "pair_id string, bottom_text string, from_page string, to_page string, created_at double, status string"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file, with file name and time; broken files are kept."""
    return (
        spark.read.schema(f"{schema}, _corrupt_record string")
        .option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(path)
        .select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"))
    )


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reports, report_regions) of quality-report documents.

    A file that is not a report has ``valid`` false.
    """
    docs = _documents(spark, path, REPORT).withColumn(
        "valid", F.col("_corrupt_record").isNull() & F.col("task_id").isNotNull()
    )
    count = F.when(F.col("regions").isNotNull(), F.size("regions")).otherwise(F.lit(0))
    reports = docs.withColumn("region_count", count).drop("_corrupt_record", "regions")
    regions = docs.where("valid").select("task_id", "file", F.posexplode("regions").alias("pos", "r")).select(
        "task_id", "file", "pos", "r.*"
    )
    return reports, regions


def write_reports(reports: DataFrame, regions: DataFrame, path: str, files: int | None = None) -> None:
    """Nest regions back into their reports, named by source slug and task id.

    ``regions``: task_id, pos and the region fields.
    """
    fields = [c for c in regions.columns if c not in ("task_id", "file", "pos")]
    nested = regions.groupBy("task_id").agg(
        F.array_sort(
            F.collect_list(F.struct("pos", F.struct(*fields).alias("r"))), lambda a, b: a["pos"] - b["pos"]
        ).alias("_r")
    ).select("task_id", F.col("_r.r").alias("regions"))
    named = reports.drop("file", "mtime", "valid", "region_count").join(nested, "task_id", "left").withColumn(
        "report_name", F.concat(source_slug("image_path"), F.lit("__"), F.col("task_id"))
    )
    out = named.repartition(files) if files else named
    out.write.mode("overwrite").json(path)


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chapters with counts, pages) of download manifests; unreadable ones have null counts."""
    docs = _documents(spark, path, MANIFEST)
    good = F.col("_corrupt_record").isNull() & F.col("pages").isNotNull()
    ok = F.size(F.filter("pages", lambda p: F.coalesce(p["ok"], F.lit(False))))
    chapters = docs.select(
        "file", "manga_id", "chapter_id", F.when(good, ok).cast("long").alias("ok_count"), F.when(good, F.size("pages")).cast("long").alias("total")
    )
    pages = docs.where(good).select("manga_id", "chapter_id", F.explode("pages").alias("p")).select("manga_id", "chapter_id", "p.*")
    return chapters, pages


def write_manifests(downloads: DataFrame, path: str) -> None:
    """One manifest document per chapter, pages in order."""
    item = F.struct("index", "url", "path", "ok", "error")
    downloads.groupBy("manga_id", "chapter_id").agg(F.array_sort(F.collect_list(item)).alias("pages")).withColumn(
        "created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    ).write.mode("overwrite").json(path)


def scan_library(spark: SparkSession, root: str) -> DataFrame:
    """Page images below a folder: series, chapter, name, page_no, length, mtime.

    Only file facts are read; the content column is never selected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    parts = F.split("path", "/")
    return files.where(ext.isin(*IMAGE_EXTENSIONS)).select(
        "path", F.element_at(parts, -3).alias("series"), F.element_at(parts, -2).alias("chapter"),
        F.element_at(parts, -1).alias("name"), natural_number(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")).alias("page_no"),
        "length", F.col("modificationTime").alias("mtime"),
    )


LOG_LINE = r"^(.*?) \| (\w+)\s* \| (.*?) \| (.*)$"


def read_app_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``time | level | name | message`` with their file and place."""
    part = lambda i: F.regexp_extract("value", LOG_LINE, i)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"), part(1).alias("time"), part(2).alias("level"), part(3).alias("name"),
        F.when(F.col("value").rlike(LOG_LINE), part(4)).otherwise(F.col("value")).alias("message"), "value",
    )


def latest_tail(logs: DataFrame, n: int = 100) -> DataFrame:
    """Last ``n`` lines of the newest file (by name).

    A sort with a limit: each task keeps its own last ``n`` lines only.
    """
    newest = logs.agg(F.max("file").alias("file"))
    return logs.join(F.broadcast(newest), "file").orderBy(F.desc("line_id")).limit(n)


ACCESS_LINE = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([A-Z]+) (\S+) ([^"]*)" (\d{3}) (\d+|-)'


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Combined-format access lines (batch or stream): host, ts, method, path, code, bytes."""
    part = lambda i: F.regexp_extract("value", ACCESS_LINE, i)
    return lines.where(F.col("value").rlike(ACCESS_LINE)).select(
        part(1).alias("host"), F.to_timestamp(part(2), "dd/MMM/yyyy:HH:mm:ss Z").alias("ts"), part(3).alias("method"),
        part(4).alias("path"), part(6).cast("int").alias("code"), part(7).try_cast("long").alias("bytes"),
    )


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_access_log(spark.read.text(path))


def append_carryover(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_carryover(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARRYOVER).json(path)


def read_slice_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per slice of every slice index."""
    docs = _documents(spark, path, SLICES)
    return docs.where("slices IS NOT NULL").select(
        F.col("file").alias("index_file"), "version", "original_width", "original_height", "slice_height", "overlap",
        F.posexplode("slices").alias("index", "s"),
    ).select("index_file", "version", "original_width", "original_height", "slice_height", "overlap", "index", "s.*")


def write_slice_index(spans: DataFrame, path: str, width: str, height: str, slice_height: int, overlap: int) -> None:
    """``spans``: page, index, start, end, width and height of the page."""
    item = F.struct("index", F.format_string("slice_%03d.webp", F.col("index")).alias("file"), F.col("start").alias("y"), (F.col("end") - F.col("start")).alias("height"))
    spans.groupBy("page", F.col(width).alias("original_width"), F.col(height).alias("original_height")).agg(
        F.array_sort(F.collect_list(item)).alias("_s")
    ).select(
        "page", F.lit(1).alias("version"), "original_width", "original_height", F.lit(slice_height).alias("slice_height"),
        F.lit(overlap).alias("overlap"), F.transform("_s", lambda s: s.dropFields("index")).alias("slices"),
    ).write.mode("overwrite").json(path)


def write_eval(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Evaluation rows as JSON, or the four comparison columns as CSV."""
    if fmt == "csv":
        rows.select("image", "upscaled", "gain_ratio", "suggest_keep").write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
