"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows (``size`` consecutive words, or the
whole of a shorter item).  A window is a set of short shingles; since the whole
window must be contained, one shingle, the rarest in the corpus, is a necessary
prefix.

1. One pass over the texts keeps the stretches of words that could hold a
   window: runs of words under shingles that a Bloom filter of the benchmark's
   shingles knows.  The filter has a fixed size, so what is sent to the tasks
   does not grow with the benchmark; false hits die in the join.
2. Equal runs are combined: a passage that a third of the documents share is
   checked once.
3. The shingles of the runs are counted over all documents, each window's
   rarest one is its prefix, and runs join windows on the prefix only.  Bounds
   on length and position leave one possible place per prefix occurrence; the
   words there are compared exactly.  Shingles travel with the key of their run and
   their position only; the words of a run are read once, beside the list of its
   possible places, so a long run costs in proportion to its length.
4. Hit words are the union of the places; results go back to the documents.

Defined results: null or empty texts have no words and are clean; items without
words have no windows; items that repeat an id are one item; a null item_id is
no name for a finding and is left out.  Rows with one doc_id are answered
together (words and hits add up).  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import (
    LOWER, WORD_BYTES, WordHash, chunks, find_words, inside_rows, row_id, stored, table, user_id, window_hash,
)
from pageloom.skew import checkpoint

#: words of a shingle; shorter windows are one shingle
SHINGLE = 5
#: bits of the Bloom filter (1 MiB), the bound of what every task receives
FILTER_BITS = 1 << 23
PROBES = 3

_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(column: str) -> F.Column:
    """Lower-cased words of a text (only A-Z are lowered), in columns."""
    lowered = F.translate(F.coalesce(F.col(column), F.lit("")), *_ASCII)
    return F.filter(F.split(lowered, _NOT_WORD), lambda w: w != "")


def _spread(h: np.ndarray) -> np.ndarray:
    """Bit numbers of each hash in the filter."""
    bits = np.uint64(FILTER_BITS - 1)
    return np.stack([(h >> np.uint64(21 * i)) & bits for i in range(PROBES)])


def _text_hash(texts) -> np.ndarray:
    """Hash of every string as a sequence of space-separated words."""
    hasher, out = WordHash(21), np.zeros(len(texts), np.uint64)
    for lo, hi, buf, offs in chunks(texts):
        starts, ends, first = find_words(buf, offs, WORD_BYTES)
        h, sizes = hasher(buf, starts, ends), np.diff(first)
        for q in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == q)
            out[lo + rows] = window_hash(h, int(q))[first[rows]]
    return out


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shingle -> (word of the filter, its bits), combined per batch."""
    for batch in batches:
        at = np.unique(_spread(_text_hash(batch.column("shingle"))))
        word, bit = (at >> np.uint64(6)).astype(np.int32), np.uint64(1) << (at & np.uint64(63))
        if len(word):
            head = np.flatnonzero(np.diff(word, prepend=-1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[head]), pa.array(np.bitwise_or.reduceat(bit, head).view(np.int64))],
                names=["word", "bits"])


def _find_runs(known: np.ndarray, sizes: tuple[int, ...]) -> Callable:
    """(_id, text) -> (_id, n_words, runs): stretches of words under known shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash(21)
        for batch in batches:
            counts, runs = [], []
            for lo, hi, buf, offs in chunks(batch.column("text")):
                buf = LOWER[buf]
                starts, ends, first = find_words(buf, offs, WORD_BYTES)
                n = len(starts)
                h = hasher(buf, starts, ends)
                step = np.zeros(n + 1, np.int32)
                for q in sizes:
                    keys = window_hash(h, q)
                    if not len(keys):
                        continue
                    hit = inside_rows(first, q, n)[:len(keys)]
                    for at in _spread(keys):
                        hit &= (known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                    found = np.flatnonzero(hit)
                    step[found] += 1
                    step[found + q] -= 1
                under = np.concatenate([[False], np.cumsum(step)[:n] > 0, [False]])
                # a run never crosses into the next text
                edge = under[1:] != under[:-1]
                edge[first[1:-1]] |= under[first[1:-1]] | under[first[1:-1] + 1]
                cuts = np.flatnonzero(edge)
                rows: list[list[str]] = [[] for _ in range(hi - lo)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if under[a + 1]:
                        text = b" ".join(bytes(buf[s:e]) for s, e in zip(starts[a:b], ends[a:b]))
                        rows[int(np.searchsorted(first, a, "right")) - 1].append(text.decode())
                counts.append(np.diff(first))
                runs += rows
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(total.astype(np.int64)), pa.array(runs, pa.list_(pa.string()))],
                names=["_id", "n_words", "runs"])

    return run


def _shingles(array: F.Column, length: F.Column) -> F.Column:
    """Shingles of a word array, in order."""
    q = F.least(length, F.lit(SHINGLE))
    return F.transform(F.sequence(F.lit(1), length - q + 1), lambda i: F.array_join(F.slice(array, i, q), " "))


def _covered(places: DataFrame) -> DataFrame:
    """Words under the union of the places [start, stop) of each run."""
    sofar = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = places.groupBy("key", "start").agg(F.max("stop").alias("stop")).withColumn(
        "before", F.coalesce(F.max("stop").over(sofar), F.lit(0)))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before"))
    return ends.groupBy("key").agg(F.sum(new).cast("long").alias("n"))


def contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit and items (sorted ids of the items found), a row per doc_id."""
    spark = docs.sparkSession
    item_words = items.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")
    ).withColumn("n", F.size("w")).where("n > 0")
    length = F.least(F.col("n"), F.lit(size))
    windows = checkpoint(item_words.select(
        "item_id", length.alias("len"),
        F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - length + 1), lambda i: F.slice("w", i, length))).alias("w"),
    ).select("item_id", "len", F.array_join("w", " ").alias("words"), _shingles(F.col("w"), F.col("len")).alias("s")))
    distinct = windows.groupBy("words").agg(F.first("len").alias("len"), F.first("s").alias("s"))
    pieces = distinct.select("words", "len", F.posexplode("s").alias("offset", "shingle"))

    # the filter has FILTER_BITS / 64 words at most
    known = np.zeros(FILTER_BITS // 64, np.uint64)
    parts = pieces.select("shingle").mapInArrow(_filter_words, "word int, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toPandas()
    known[parts["word"].to_numpy()] = parts["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    # shingle sizes in use: 1 to SHINGLE
    sizes = tuple(sorted(int(r.q) for r in windows.select(F.least("len", F.lit(SHINGLE)).alias("q")).distinct().collect()))

    found = stored(docs.select(row_id().alias("_id"), "text").mapInArrow(
        _find_runs(known, sizes), "_id long, n_words long, runs array<string>"))
    doc_runs = found.select("_id", F.explode("runs").alias("run")).select("_id", F.md5("run").alias("key"), "run")
    runs = stored(doc_runs.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.first("run").alias("run")))
    split = runs.select("key", "docs", F.split("run", " ").alias("w")).withColumn("n", F.size("w"))
    run_shingles = split.withColumn("q", F.explode(F.array(*[F.lit(q) for q in sizes or (1,)]))).where("n >= q").select(
        "key", "docs", "n",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("q") + 1),
                                 lambda i: F.array_join(F.slice("w", i, F.col("q")), " "))).alias("at", "shingle"))

    seen = run_shingles.groupBy("shingle").agg(F.sum("docs").alias("seen"))
    prefix = pieces.join(seen, "shingle").groupBy("words").agg(
        F.min(F.struct("seen", "shingle", "offset")).alias("p"), F.first("len").alias("len"), F.count(F.lit(1)).alias("have"),
    # every shingle of a window that occurs was seen
    ).where("have = len - least(len, %d) + 1" % SHINGLE).select(
        "words", "len", F.col("p.shingle").alias("shingle"), F.col("p.offset").alias("offset"))
    start = F.col("at") - F.col("offset")
    possible = run_shingles.join(prefix, "shingle").withColumn("start", start).where(
        (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))
    ).groupBy("key").agg(F.collect_list(F.struct("start", "len", "words")).alias("places"))
    held = F.filter("places", lambda p: F.array_join(F.slice("w", p["start"] + 1, p["len"]), " ") == p["words"])
    places = stored(possible.join(split.select("key", "w"), "key").select("key", F.explode(held).alias("p")).select(
        "key", "p.words", "p.start", (F.col("p.start") + F.col("p.len")).alias("stop")))

    names = places.select("key", "words").distinct().join(windows.select("words", "item_id").distinct(), "words")
    verdict = _covered(places).join(
        names.groupBy("key").agg(F.collect_set("item_id").alias("items")), "key")
    per_doc = doc_runs.select("_id", "key").join(verdict, "key")
    sums = per_doc.groupBy("_id").agg(
        F.sum("n").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    counts = found.groupBy("_id").agg(F.sum("n_words").alias("n_words"))
    empty = F.array().cast("array<string>")
    return counts.join(sums, "_id", "left").select(
        user_id("_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", empty).alias("items"))


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SPLIT = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS t
  FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
dw AS (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS t
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hits AS (SELECT doc_id, i, dw.l AS l, item_id FROM dw JOIN bw USING (t)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN names USING (doc_id)
"""
