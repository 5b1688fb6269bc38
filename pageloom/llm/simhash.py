"""SimHash near-duplicates through vantage-point trees.

A fingerprint has 64 bits; two are linked when they differ in at most ``radius``
bits.  Equal fingerprints are one point, so copies never meet in pairs.

A tree of vantage points deals points out to shards: a node measures the Hamming
distance to its vantage point and has one child for every distance.  By the
triangle inequality a point within ``radius`` of a query differs by at most
``radius`` in distance to the vantage point, so a query visits only the children
around its own distance: its own shard, and those whose border it overlaps.  The
depth of the shared tree grows with the number of points; below it every shard
continues with a tree of its own, and compares exactly where little is left.
Queries of one shard are dealt over several tasks.

A shard returns a spanning forest of its links, at most one row per query, and
components are joined over these.  A fingerprint has at most 2080 neighbours
within two bits, so no group can make a quadratic number of links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import row_id, table, user_id
from pageloom.operators.graph import connected_components
from pageloom.skew import checkpoint

BITS = 64
#: queries of one shard per task, points of one shard aimed at
QUERIES_PER_TASK, POINTS_PER_SHARD = 20_000, 4_000
#: pairs compared at once
DIRECT = 1 << 18
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles, repeats included; no words give zero."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(BITS, np.int64), max(1, n - shingle + 1)
    for lo in range(0, total, 1 << 16):  # long texts a block at a time
        hi = min(total, lo + (1 << 16))
        hashes = np.fromiter(
            (digest(b" ".join(words[i:i + shingle]), SEED) for i in range(lo, hi)), dtype=np.uint64, count=hi - lo)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > total, bitorder="little")
    return int(packed.view(np.uint64)[0])


def _fingerprints(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (t.as_buffer() for t in batch.column("text"))
            marks = np.fromiter((fingerprint(b"" if t is None else t.to_pybytes(), shingle) for t in raw),
                                dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(marks.view(np.int64))], names=["_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(_id, fp) of every row; bytes.lower and bytes.split are the contract's words."""
    return docs.select(row_id().alias("_id"), "text").mapInArrow(_fingerprints(shingle), "_id long, fp long")


# ---------------------------------------------------------------------------
# vantage-point trees
# ---------------------------------------------------------------------------

def _vantage(path: tuple[int, ...]) -> np.uint64:
    """The vantage point of a node: any fixed word will do, since fingerprints look random."""
    return np.uint64(xxhash.xxh64_intdigest(repr(path).encode(), SEED))


def _distance(x: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ v).astype(np.int16)


def _deal(depth: int, radius: int, splits: int) -> Callable:
    """fp -> (shard, part, fp, own): a point in its shard, queries where their ball reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vantage = [_vantage((level,)) for level in range(depth)]
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            own = np.zeros(len(fp), np.int64)
            which, shard = np.arange(len(fp)), np.zeros(len(fp), np.int64)
            for v in vantage:
                d = _distance(fp, v)
                own = own * (BITS + 1) + d
                reach = d[which][:, None] + np.arange(-radius, radius + 1)
                ok = (reach >= 0) & (reach <= BITS)
                shard = (shard[:, None] * (BITS + 1) + reach)[ok]
                which = np.repeat(which, ok.sum(axis=1))
            # points go to every part of their shard, a query to one part
            part = (mixed(fp) % np.uint64(splits)).astype(np.int32)
            yield _rows(np.repeat(own, splits), np.tile(np.arange(splits, dtype=np.int32), len(fp)), np.repeat(fp, splits), True)
            for lo in range(0, len(which), 1 << 18):
                at = which[lo:lo + (1 << 18)]
                yield _rows(shard[lo:lo + (1 << 18)], part[at], fp[at], False)

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


def _rows(shard, part, fp, point) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shard), pa.array(part), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), point))],
        names=["shard", "part", "fp", "point"])


def near_pairs(points: np.ndarray, queries: np.ndarray, radius: int, path: tuple = (-1,)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) within the radius, query < point, each once; walks a vantage-point tree."""
    if not len(points) or not len(queries):
        return
    if len(points) <= 24 or len(points) * len(queries) <= DIRECT:
        step = max(1, DIRECT // len(points))
        for lo in range(0, len(queries), step):
            q = queries[lo:lo + step]
            i, j = np.nonzero(np.bitwise_count(q[:, None] ^ points[None, :]) <= radius)
            less = q[i] < points[j]
            yield q[i[less]], points[j[less]]
        return
    v = _vantage(path)
    dp, dq = _distance(points, v), _distance(queries, v)
    op, oq = np.argsort(dp, kind="stable"), np.argsort(dq, kind="stable")
    dp, dq, points, queries = dp[op], dq[oq], points[op], queries[oq]
    for d in np.unique(dp):
        a, b = np.searchsorted(dp, [d, d + 1])
        qa, qb = np.searchsorted(dq, [d - radius, d + radius + 1])
        if b - a == len(points) and qb - qa == len(queries) and len(path) > BITS:
            raise ValueError("points are not distinct")
        yield from near_pairs(points[a:b], queries[qa:qb], radius, (*path, int(d)))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) with the components of the links (a, b), one per node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _search(radius: int) -> Callable:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        fp, point = group["fp"].to_numpy().view(np.uint64), group["point"].to_numpy(dtype=bool)
        found = list(near_pairs(fp[point], fp[~point], radius))
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
        if len(a):
            a, b = forest(a, b)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp (signed 64-bit) and component_id (smallest doc_id reachable), a row per input row.

    A null or empty text has the fingerprint zero, linked like any other.  A null
    doc_id stands before all others and its component_id is null.  Rows with one
    doc_id have each their own fingerprint.  Other columns are ignored.
    """
    marks = checkpoint(fingerprints(docs, shingle))
    points = checkpoint(marks.groupBy("fp").agg(F.min("_id").alias("least")))
    n = points.count()
    # each level divides the points by about ten and repeats a query up to five times
    depth = max(1, math.ceil(math.log10(max(1, n / POINTS_PER_SHARD)))) if n > POINTS_PER_SHARD else 0
    visits = n * ((radius * 2 + 1) * 0.9) ** depth / 10**depth
    splits = max(1, math.ceil(visits / QUERIES_PER_TASK))
    dealt = points.select("fp").mapInArrow(_deal(depth, radius, splits), "shard long, part int, fp long, point boolean")
    links = checkpoint(dealt.groupBy("shard", "part").applyInPandas(_search(radius), "a long, b long"))
    named = connected_components(links).join(points.withColumnRenamed("fp", "node"), "node")
    roots = named.groupBy("component").agg(F.min("least").alias("_least"))
    linked = named.join(roots, "component").select(F.col("node").alias("fp"), "_least")
    of = points.join(linked, "fp", "left").select("fp", F.coalesce("_least", "least").alias("component"))
    return marks.join(of, "fp").select(
        user_id("_id").alias("doc_id"), "fp", user_id("component").alias("component_id"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
