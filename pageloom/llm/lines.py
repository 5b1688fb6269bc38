"""Line deduplication with levelled sorted runs of line hashes.

The index of line keys is kept as in a log-structured store.  Every batch of
documents writes one run: a table of (key, documents with it, largest document),
sorted by key and bucketed on it, so that runs meet in merge joins without moving
again.  When ``fanout`` runs of one level have gathered they are merged into a run
of the next level.  A new batch is merge-anti-joined with the runs to tell keys
never seen from those to add to, and then adds its own run.

Keys that enough documents hold lose their lines everywhere but in the largest
document; the line numbers to drop go back to the texts in one join.

Runs are written as Parquet below the shared folder; a lost executor reads them
again.  Nothing is collected: a key is only ever counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import deleted, row_id, table, user_id
from pageloom.skew import shared_folder

STRIPPED = " \t\n\x0b\f\r"
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    """The text by which lines are compared."""
    return F.translate(F.trim(line, F.lit(STRIPPED)), *_ASCII)


class LineIndex:
    """Counts of line keys over all batches added so far."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.name}"
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, entries: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.written}"
        self.written += 1
        entries.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option(
            "path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        """Merge all runs of a level into one of the next."""
        names, self.levels[level] = self.levels[level], []
        self._write(self._merge(names), level + 1)
        for name in names:
            # the files of a table with a path of its own outlive it
            self.spark.sql(f"DROP TABLE {name}")
            deleted(self.spark, f"{self.folder}/{name}")

    def _merge(self, names: list[str]) -> DataFrame:
        """Merge sorted runs, in which every key is once, by merge joins on their buckets.

        Not a union with an aggregate over it: this Spark takes a union of bucketed
        scans for bucketed, reads their buckets apart, and so leaves keys unmerged.
        """
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select(*KEY, *[F.col(c).alias(f"_{c}") for c in ("docs", "last", "fresh")])
            rows = rows.join(other.hint("merge"), KEY, "full_outer").select(
                *KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))).alias("docs"),
                F.greatest("last", "_last").alias("last"), F.greatest("fresh", "_fresh").alias("fresh"))
        return rows

    @property
    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows whose key no run holds: one merge anti-join per run."""
        for name in self.runs:
            keys = keys.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, lines: DataFrame) -> None:
        """Add a batch: (k1, k2, _id), documents that no earlier batch had."""
        own = lines.select(*KEY, "_id").distinct().groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("docs"), F.max("_id").alias("last"))
        if self.runs:
            own = own.repartition(self.buckets, *KEY)
            new = self.unseen(own.select(*KEY)).withColumn("fresh", F.lit(True))
            own = own.join(new.hint("merge"), KEY, "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
        else:
            own = own.withColumn("fresh", F.lit(True))
        self._write(own.select(*KEY, "docs", "last", "fresh"), 0)

    def entries(self) -> DataFrame:
        """One row per key: docs, last."""
        return self._merge(self.runs).select(*KEY, "docs", "last")


def _lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """Keys of all lines long enough: (_id, _tag, no, k1, k2)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        row_id().alias("_id"), F.xxhash64(text).alias("_tag"),
        F.posexplode(F.split(text, "\n", -1)).alias("no", "line"),
    ).where(F.length("line") >= min_chars).select("_id", "_tag", "no", line_key(F.col("line")).alias("key"))
    return lines.where(F.length("key") >= min_chars).select(
        "_id", "_tag", "no", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(7), F.col("key")).alias("k2"))


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row.., text, gone) -> text without the lines numbered in ``gone``."""
    for batch in batches:
        total, dropped, kept = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            lines = (text or "").split("\n")
            out = set(gone or ())
            stay = [x for i, x in enumerate(lines) if i not in out] if out else lines
            total.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
        columns = {n: batch.column(n) for n in batch.schema.names if n not in ("gone", "text")}
        columns |= {"n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()),
                    "kept_text": pa.array(kept, pa.string())}
        yield pa.RecordBatch.from_pydict(columns)


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text and the columns named in ``keep``, a row per input row.

    A line is dropped when its key has at least ``min_chars`` code points, at least
    ``min_docs`` doc_ids hold it and this row's doc_id is not the largest of them.
    A null or empty text is one empty line.  Null doc_ids count as one document before
    all others; rows with one doc_id count as one document and are answered one by one.
    Documents come in ``batches`` ranges of their ids, as deliveries would.
    """
    spark = docs.sparkSession
    index = LineIndex(spark)
    where = f"{index.folder}/lines"
    bounds = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = bounds["lo"] or 0, bounds["hi"] or 0
    at = F.floor((F.col("_id").cast("decimal(38,0)") - lo) * batches / (hi - lo + 1))
    batch = F.greatest(F.lit(0), F.least(at, F.lit(batches - 1))).cast("int")
    _lines_of(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(where)
    lines = spark.read.schema("_id long, _tag long, no int, k1 long, k2 long, batch int").parquet(where)
    for b in range(batches):
        index.add(lines.where(F.col("batch") == b))
    frequent = index.entries().where(F.col("docs") >= min_docs)
    gone = lines.join(frequent, KEY).where("_id <> last").groupBy("_id", "_tag").agg(F.collect_set("no").alias("gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [F.col(c).alias(f"_keep_{c}") for c in keep]
    rows = docs.select(row_id().alias("_id"), F.xxhash64(text).alias("_tag"), "text", *rest).join(
        gone, ["_id", "_tag"], "left").drop("_tag")
    kinds = rows.drop("text", "gone").select("*", *(F.lit(None).cast(t).alias(n) for n, t in (
        ("n_lines", "long"), ("n_dropped", "long"), ("kept_text", "string")))).schema
    done = rows.mapInArrow(_drop, kinds)
    return done.select(
        user_id("_id").alias("doc_id"), "n_lines", "n_dropped", "kept_text", *[F.col(f"_keep_{c}").alias(c) for c in keep])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
numbered AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM numbered),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, i, line, f.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN frequent f USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
