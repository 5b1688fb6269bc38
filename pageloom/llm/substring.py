"""Removal of repeated passages by difference-cover anchors.

A passage is ``window`` consecutive words.  Hashing every window of a corpus
would move one row per word.  Instead only anchors of ``window - PERIOD + 1``
words are hashed, and only where the position modulo ``PERIOD`` lies in a
difference cover.  For any two positions there is a shift below ``PERIOD`` that
brings both into the cover, so two equal windows always share an anchor at the
same place inside them.  Windows around an anchor seen more than once are then
extended to their full length, keyed by 96 bits and ordered by where they
start; every window but the first is a repeat.

Steps: (1) exact copies are set aside (of a copy of at least ``window`` words
everything goes), (2) anchors that occur twice, (3) full windows around them,
(4) words covered by a repeat leave the text.  The texts are exchanged once, by
document; Spark reuses that exchange in all three steps.  Every group (an anchor,
a window) is only sorted and streamed, never held.

Defined results: a null or empty text has no words; a null doc_id stands before
all others; rows with one doc_id are judged separately, and equal windows that
start at the same (doc_id, start) are both kept.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import NOT_SPACE, WordHash, chunks, find_words, inside_rows, row_id, user_id, window_hash

#: every residue modulo 13 is a difference of two of these
PERIOD, COVER = 13, (0, 1, 3, 9)
KEY = ["_id", "_tag"]


def _anchors(window: int) -> Callable:
    """(_id, _tag, text) -> (anchor, _id, _tag, pos)."""
    length = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash(11)
        covered = np.isin(np.arange(PERIOD), COVER)
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy() for c in KEY)
            for lo, hi, buf, offs in chunks(batch.column("text")):
                starts, ends, first = find_words(buf, offs, NOT_SPACE)
                n = len(starts)
                pos = np.arange(n) - np.repeat(first[:-1], np.diff(first))
                # a window must fit, not only its anchor
                left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
                words = np.repeat(np.diff(first), np.diff(first))
                at = np.flatnonzero(covered[pos % PERIOD] & (left >= length) & (words >= window))
                if not len(at):
                    continue
                keys = window_hash(hasher(buf, starts, ends), length)[at]
                row = lo + np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(ids[row]), pa.array(tags[row]),
                     pa.array(pos[at].astype(np.int32))], names=["anchor", *KEY, "pos"])

    return run


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; a null list is empty."""
    offs = np.zeros(len(column) + 1, np.int64)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    offs[1:] = np.cumsum(sizes)
    return column.flatten().to_numpy(zero_copy_only=False), offs


def _windows(window: int) -> Callable:
    """(_id, _tag, text, at) -> full windows around the anchors: (w1, w2, _id, _tag, start, later).

    A document gives a window once, at its first start; ``later`` has the others.
    """
    slack = PERIOD - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = WordHash(12), WordHash(13)
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy() for c in KEY)
            at, at_offs = _flat(batch.column("at"))
            for lo, hi, buf, offs in chunks(batch.column("text")):
                starts, ends, first = find_words(buf, offs, NOT_SPACE)
                n = len(starts)
                counts = at_offs[lo + 1:hi + 1] - at_offs[lo:hi]
                base = np.repeat(first[:-1], counts)
                anchor = at[at_offs[lo]:at_offs[hi]] + base
                step = np.zeros(n + 2, np.int32)
                np.add.at(step, np.maximum(anchor - slack, base), 1)
                np.add.at(step, anchor + 1, -1)
                near = (np.cumsum(step)[:n] > 0) & inside_rows(first, window, n)
                here = np.flatnonzero(near)
                if not len(here):
                    continue
                w1 = window_hash(one(buf, starts, ends), window)[here]
                w2 = (window_hash(two(buf, starts, ends), window)[here] >> np.uint64(32)).astype(np.uint32)
                local = np.searchsorted(first, here, "right") - 1
                start = (here - first[local]).astype(np.int32)
                own = w1 ^ (local.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.argsort(own, kind="stable")
                new = np.ones(len(own), bool)
                new[1:] = (own[order][1:] != own[order][:-1]) | (w2[order][1:] != w2[order][:-1])
                row, run_of = order[new], np.cumsum(new) - 1
                more = np.bincount(run_of, minlength=len(row)) - 1
                later = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(more)]).astype(np.int32)), pa.array(start[order[~new]]),
                    mask=pa.array(more == 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1[row].view(np.int64)), pa.array(w2[row].view(np.int32)), pa.array(ids[lo + local[row]]),
                     pa.array(tags[lo + local[row]]), pa.array(start[row]), later],
                    names=["w1", "w2", *KEY, "start", "later"])

    return run


def _strip(window: int) -> Callable:
    """(_id, text, copy, dup) -> (_id, n_words, n_removed, kept_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dup, dup_offs = _flat(batch.column("dup"))
            copies = batch.column("copy").to_pylist()
            total, removed, kept = [], [], []
            for i, text in enumerate(batch.column("text")):
                raw = text.as_buffer()
                words = b"" if raw is None else raw.to_pybytes()
                words = words.split()
                n = len(words)
                mine = dup[dup_offs[i]:dup_offs[i + 1]]
                gone = 0
                if copies[i]:
                    gone = n if n >= window else 0
                    words = words if not gone else []
                elif len(mine):
                    step = np.zeros(n + window + 1, np.int32)
                    np.add.at(step, mine, 1)
                    np.add.at(step, mine + window, -1)
                    stay = np.flatnonzero(np.cumsum(step)[:n] == 0)
                    gone, words = n - len(stay), [words[j] for j in stay]
                total.append(n)
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())], names=["_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space), a row per input row."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(row_id().alias("_id"), F.xxhash64(text).alias("_tag"), text.alias("text"))
    # of equal texts one stays: ids and digests only, combined before the exchange
    originals = (
        texts.select(*KEY, F.sha2("text", 256).alias("_sha"))
        .groupBy("_sha").agg(F.min("_id").alias("_id"), F.first("_tag").alias("_tag")).select(*KEY)
    )
    anchors = texts.join(originals, KEY, "left_semi").mapInArrow(
        _anchors(window), "anchor long, _id long, _tag long, pos int")
    along = Window.partitionBy("anchor").orderBy("anchor")
    shared = anchors.withColumns({
        "_before": F.lag(F.lit(1)).over(along), "_after": F.lead(F.lit(1)).over(along),
    }).where("_before is not null or _after is not null")
    places = shared.groupBy(*KEY).agg(F.collect_set("pos").alias("at"))
    windows = texts.join(places, KEY).mapInArrow(
        _windows(window), "w1 long, w2 int, _id long, _tag long, start int, later array<int>")
    order = Window.partitionBy("w1", "w2").orderBy("_id", "start")
    more = F.coalesce("later", F.array().cast("array<int>"))
    repeats = windows.withColumn("_rank", F.rank().over(order)).where("_rank > 1 or later is not null").select(
        *KEY, F.explode(F.when(F.col("_rank") > 1, F.array_append(more, F.col("start"))).otherwise(more)).alias("start"))
    facts = originals.select(*KEY, F.lit(None).cast("int").alias("start"), F.lit(True).alias("_first")).unionByName(
        repeats.select(*KEY, "start", F.lit(None).cast("boolean").alias("_first"))
    ).groupBy(*KEY).agg(F.max("_first").alias("_first"), F.collect_set("start").alias("dup"))
    done = texts.join(facts, KEY, "left").select(
        "_id", "text", F.col("_first").isNull().alias("copy"), "dup"
    ).mapInArrow(_strip(window), "_id long, n_words long, n_removed long, kept_text string")
    return done.select(user_id("_id").alias("doc_id"), "n_words", "n_removed", "kept_text")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, rank() OVER (PARTITION BY t ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(g.p) AS n_removed,
    string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE g.p IS NULL) AS t
  FROM words LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
