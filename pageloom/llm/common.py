"""Helpers shared by the training-data operators.

Row identity.  Ids may be null or repeat.  ``row_id`` gives a null id the place
before all others, and ``user_id`` turns it back.  Operators that bring results
back to the texts join on an id whose right side is unique, so repeated rows
are answered one by one and never multiply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.skew import stored  # noqa: F401 - also used by the operators of pages

NULL_ID = -(2**63)
#: texts are hashed in blocks of about this many bytes, whatever their length
BLOCK = 1 << 19

SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def deleted(spark: SparkSession, folder: str) -> None:
    """Delete a folder written by this session; nothing may read it afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder) if ":/" in folder else folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def given_up(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames, once nothing reads it any more."""
    for df in frames:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            deleted(df.sparkSession, folder)


def row_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def user_id(column: str) -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


# ---------------------------------------------------------------------------
# words as positions in the UTF-8 bytes of a batch
# ---------------------------------------------------------------------------

def byte_set(members) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


NOT_SPACE = ~byte_set(SPACE_BYTES)
#: 0-9, a-z and every byte of a character beyond ASCII; A-Z count once lowered
WORD_BYTES = byte_set([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def chunks(column, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of an Arrow string column in pieces: (first row, last row, bytes, offsets).

    A piece holds about ``limit`` bytes, or one longer text.  A null has no bytes.
    """
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    wide = np.int64 if str(column.type).startswith("large") else np.int32
    offs = np.frombuffer(offsets, dtype=wide)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def find_words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray):
    """Start and end byte of every word, and for each row its first word (n+1 numbers)."""
    inside = member[buf]
    if not len(inside):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offs), np.int64)
    borders = offs[(offs > 0) & (offs < len(buf))]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[borders - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def by_bytes(batch, column: str = "text", limit: int = 4 << 20) -> Iterator:
    """Runs of rows of a record batch with about ``limit`` bytes of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    total, lo = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of words by prefix sums over their bytes, a block at a time."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62)) | 1
        self.byte = rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._tables(BLOCK)

    def _tables(self, n: int) -> None:
        power = np.full(n + 1, self.base, dtype=np.uint64)
        power[0] = 1
        inverse = np.full(n + 1, pow(self.base, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        self.power, self.inverse = np.cumprod(power), np.cumprod(inverse)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        i = 0
        while i < len(starts):
            a = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, a + BLOCK, "right")))
            b = int(ends[j - 1])
            if b - a > len(self.power) - 1:
                self._tables(b - a)
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(self.byte[buf[a:b]] * self.power[:b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * self.inverse[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)


_C = 0x9E3779B97F4A7C15


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive numbers, by doubling; rows are not told apart."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, level, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out, have = level, size
            else:
                shift = np.uint64(pow(_C, size, 1 << 64))
                m = min(len(out), len(level) - have)
                out, have = out[:m] * shift + level[have:have + m], have + size
        if have == k:
            return mix(out[:n] + np.uint64(k))
        shift = np.uint64(pow(_C, size, 1 << 64))
        level = level[:-size] * shift + level[size:]
        size *= 2


def inside_rows(first_word: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n word positions begin k words of one row."""
    left = np.repeat(first_word[1:], np.diff(first_word)) - np.arange(n)
    return left >= k
