"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last ``ROLL`` bytes decides where chunks end: at block size
2^k a chunk ends where the hash has k trailing one bits, so what stands in the text
before those bytes has no say, and an insertion moves no boundary behind it.  The
block size of a text is the smallest at which it has at most ``CHUNKS`` chunks.  A
signature has one character for each chunk, in order; a fingerprint is k and the
signatures at ``SIZES`` doubling block sizes from 2^k on, parted by colons, so a text
and its half still have a block size in common.

The likeness of two fingerprints is the best of their signatures at a common block
size: one less the edit distance (insertions and deletions) over the length of both.
Signatures without a run of ``RUN`` characters in common (half of the shorter one where
that is less, two at least) are not alike, since chance alone gives single characters.
Equal fingerprints have likeness 1, block sizes that do not meet have 0.

Texts are hashed in blocks of bytes, whatever their length; what a text keeps is one
count per block size and its last ``CHUNKS`` boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pageloom.llm.common import BLOCK, by_bytes, chunks, mix, row_id, table, user_id
from pageloom.skew import checkpoint

#: bytes seen by the rolling hash; most characters of the finer signature
ROLL, CHUNKS = 7, 64
#: signatures of a fingerprint
SIZES = 3
#: characters in a row that alike signatures share
RUN = 4
#: rows of a run of neighbouring documents, and how many runs there are at most
ROWS, RUNS, SAMPLES = 16_384, 20_000, 20
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

_BYTE = np.random.default_rng(13).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(ROLL)]


def _rolling(buf: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Hash of the last ``ROLL`` bytes of a text at the positions lo..hi of a buffer of texts."""
    back = min(lo, ROLL - 1)
    value = _BYTE[buf[lo - back:hi]]
    at = np.arange(lo, hi)
    inside = at - offs[np.searchsorted(offs, at, "right") - 1]
    total = value[back:].copy()
    for k in range(1, ROLL):
        skip = max(0, k - back)  # bytes without k others before them in the buffer
        if skip < hi - lo:
            part = value[back - k + skip:back - k + hi - lo] * _POWER[k]
            total[skip:] += np.where(inside[skip:] >= k, part, np.uint64(0))
    return mix(total)


def _levels(x: np.ndarray) -> np.ndarray:
    """Trailing one bits of each hash."""
    low = ~x & (x + np.uint64(1))
    return np.bitwise_count(low - np.uint64(1))


def _signatures(buf: np.ndarray, offs: np.ndarray) -> list[str]:
    """Fingerprints of the texts that lie between ``offs`` in a buffer of bytes."""
    n, size = len(offs) - 1, len(buf)
    spans = [(lo, min(lo + BLOCK, size)) for lo in range(0, size, BLOCK)]

    def blocks() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Start of a block, hashes, places of possible boundaries and their levels."""
        for lo, hi in spans:
            x = _rolling(buf, offs, lo, hi)
            at = np.flatnonzero(x & np.uint64(1))
            yield lo, x, at, _levels(x[at])

    # one short block is looked at once
    held = list(blocks()) if len(spans) == 1 else None
    count = np.zeros((n, 66), np.int64)
    for lo, _, at, level in held or blocks():
        row = np.searchsorted(offs, at + lo, "right") - 1
        count += np.bincount(row * 66 + level, minlength=n * 66).reshape(n, 66)
    above = count[:, ::-1].cumsum(axis=1)[:, ::-1]
    # a rest after the last boundary is a chunk too
    fine = np.maximum(1, (above >= CHUNKS).sum(axis=1))
    marks, sums, levels, carried = [], [], [], np.uint64(0)
    for lo, x, at, level in held or blocks():
        row = np.searchsorted(offs, at + lo, "right") - 1
        far = level >= fine[row]
        total = np.cumsum(x, dtype=np.uint64) + carried
        ends = offs[(offs > lo) & (offs <= lo + len(x))]
        place = np.concatenate((at[far] + lo + 1, ends))
        marks.append(place)
        sums.append(total[place - lo - 1])
        levels.append(np.concatenate((level[far], np.full(len(ends), 127, np.uint8))))
        carried = total[-1]
    none = np.zeros(0, np.int64)
    place, total, level = np.concatenate([none, *marks]), np.concatenate([none.astype(np.uint64), *sums]), np.concatenate([none, *levels])
    order = np.lexsort((-level, place))
    place, total, level = place[order], total[order], level[order]
    first = np.diff(place, prepend=-1) > 0  # a boundary at the end of a text stands once
    place, total, level = place[first], total[first], level[first]
    row = np.searchsorted(offs, place, "left") - 1
    # empty texts share their end with others; the boundary belongs to the last text that has bytes
    parts = []
    for more in range(SIZES):
        some = level >= fine[row] + more
        sign = ALPHABET[(mix(np.diff(total[some], prepend=np.uint64(0))) >> np.uint64(58)).astype(np.int64)]
        cut = np.searchsorted(row[some], np.arange(n + 1))
        text = sign.tobytes().decode()
        parts.append([text[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())])
    return [":".join(map(str, row)) for row in zip(fine.tolist(), *parts)]


def fingerprints_of(texts: pa.Array) -> list[str]:
    """Fingerprint of each text; a null counts as empty."""
    out: list[str] = []
    for _, _, buf, offs in chunks(texts, BLOCK):
        out += _signatures(buf, offs)
    return out


def _distance(a: str, b: str) -> int:
    """Insertions and deletions that make b of a; a row of the table is one number, a bit for each character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        met = row & where.get(c, 0)
        row = (row + met | row - met) & every
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def _alike(a: str, b: str) -> float:
    run = max(2, min(RUN, min(len(a), len(b)) // 2))
    if min(len(a), len(b)) < run or {a[i:i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i:i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 1 - _distance(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    (k, *x), (m, *y) = a.split(":"), b.split(":")
    apart = int(m) - int(k)
    return max((_alike(p, q) for p, q in zip(x[max(0, apart):], y[max(0, -apart):])), default=0.0)


@F.pandas_udf(DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """``likeness`` of two columns of fingerprints; null where one is null."""
    return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b)], dtype="float64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint, a row per input row.

    A null text counts as empty; ids may be null or repeat.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fingerprints_of(batch.column(2)), pa.string())],
                names=["doc_id", "n_chars", "fingerprint"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.alias("text")).mapInArrow(
        run, "doc_id long, n_chars long, fingerprint string")


# ---------------------------------------------------------------------------
# every document beside the next one
# ---------------------------------------------------------------------------

def _run_of(ids: np.ndarray, tags: np.ndarray):
    """Column function: the run, counted from the largest row down, that a row (_id, _tag) lies in.

    ``ids`` and ``tags`` are the sorted lower ends of all runs but the last.
    """

    @F.pandas_udf("int")
    def run(i: pd.Series, t: pd.Series) -> pd.Series:
        low, high = np.searchsorted(ids, i, "left"), np.searchsorted(ids, i, "right")
        tied = np.flatnonzero(low < high)
        for at in tied.tolist():
            low[at] += np.searchsorted(tags[low[at]:high[at]], t.iat[at], "right")
        return pd.Series(len(ids) - low)

    return run


def beside_next(docs: DataFrame) -> DataFrame:
    """run, last, _id, text: runs of rows in descending order of (doc_id, text hash).

    A run ends with a copy (last = 1) of the row that follows it, so that every row
    has its successor in its own run; the very last row is followed by the first.
    Runs are cut at rows chosen from a hash sample of bounded size, read from a
    written table of ids, so a repeated task finds the same cuts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(row_id().alias("_id"), text.alias("text")).withColumn("_tag", F.xxhash64("text"))
    known = checkpoint(rows.select("_id", "_tag"))
    total = known.count()
    runs = min(RUNS, max(1, -(-total // ROWS)))
    ids = tags = np.zeros(0, np.int64)
    if runs > 1:
        every = max(1, total // (SAMPLES * runs))
        # at most about SAMPLES rows for each run
        some = known.distinct().where(F.pmod(F.xxhash64("_id", "_tag", F.lit(7)), F.lit(every)) == 0).toPandas().sort_values(["_id", "_tag"])
        cuts = some.iloc[np.unique(np.linspace(0, len(some), runs + 1)[1:-1].astype(int))] if len(some) else some
        ids, tags = cuts["_id"].to_numpy(np.int64), cuts["_tag"].to_numpy(np.int64)
    run = _run_of(ids, tags)("_id", "_tag")
    # one row for each run: RUNS at most
    heads = known.groupBy(run.alias("run")).agg(F.max(F.struct("_id", "_tag")).alias("head")).orderBy("run").collect()
    spark = docs.sparkSession
    after = [(heads[i - 1].run, h.head._id, h.head._tag) for i, h in enumerate(heads)]
    copies = spark.createDataFrame(after, "before int, _id long, _tag long")
    placed = rows.withColumn("run", run).join(F.broadcast(copies), ["_id", "_tag"], "left").select(
        F.explode(F.array(F.struct(F.col("run"), F.lit(0).alias("last")), F.struct(F.col("before").alias("run"), F.lit(1).alias("last")))).alias("p"),
        "_id", "_tag", "text").where("p.run is not null")
    return placed.select("p.run", "p.last", "_id", "_tag", "text").repartitionById(max(1, runs), F.col("run")).sortWithinPartitions(
        "run", "last", F.desc("_id"), F.desc("_tag")).select("run", "last", "_id", "text")


EDITED = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``beside_next`` -> every row (but copies) with its edited text and its successor's fingerprint."""
    import hashlib

    before = None
    for batch in batches:
        for part in by_bytes(batch):
            texts = part.column("text")
            pairs = []
            for row in zip(part.column("run").to_pylist(), part.column("last").to_pylist(), part.column("_id").to_pylist(),
                           texts.to_pylist(), fingerprints_of(texts)):
                if before is not None and not before[1] and before[0] == row[0]:
                    pairs.append((before, row))
                before = row
            edited = [a[3][:len(a[3]) - len(a[3]) // 2] + b[3][:len(a[3]) // 2] for a, b in pairs]
            marks = fingerprints_of(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_arrays([
                pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([a[4] for a, _ in pairs], pa.string()), pa.array(marks, pa.string()),
                pa.array([likeness(a[4], m) for (a, _), m in zip(pairs, marks)], pa.float64()),
                pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
            ], names=[c.split()[0] for c in EDITED.split(", ")])


def edits_with_next(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document.

    The edited text has the second half replaced by as much of the start of the next
    document, in descending order of doc_id (a null id is the smallest); rows with one
    doc_id follow each other by the hash of their text.  A single row follows itself.
    Null texts count as empty.  Other columns are ignored.
    """
    return beside_next(docs).mapInArrow(_edit, EDITED).withColumn("_id", user_id("_id")).withColumnRenamed("_id", "doc_id")


def op13_piecewise_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edits_with_next(table(spark, sf_dir, "documents"))
