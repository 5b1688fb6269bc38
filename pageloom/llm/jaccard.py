"""Near-duplicates by exact Jaccard similarity of word shingles.

Two texts are linked when their sets of ``SHINGLE`` consecutive words (of all words
where there are fewer) have a Jaccard similarity of at least ``NUM``/``DEN``.  Texts
with equal sets are one point, so copies never meet in pairs.

A pair that similar shares ``NUM``/``DEN`` of the larger set, so whatever the order
of shingles is, it has one in common among the first fifth of each (prefix filter), and
what lies behind cannot make up for too few there: every pair is found.  The order only decides the work: shingles that many texts of a
sample hold come last.  Candidates are compared by their whole sets.

A shingle at place i of n bounds what a pair can share from there on, and the first one
that both hold leaves them all the rest (positional filter): a pair is only taken up under
a shingle behind which both have enough left.  A copy of which more than a ninth is its own
thus meets no other of its size, however many texts share the rest.

Pairs inside a large group of near copies are not all needed.  First every point is
compared with its neighbour by size under each shingle; what that leaves apart is
compared in full, but only across the components found.  Of both, only pairs whose
first fifths may have enough in common are compared by whole sets.  How much they have in
common at most is told by a sketch of each, a bitmap of its hashes: every bit that only one
of two sketches has stands for a shingle that only that one holds.  Pairs thus carry some
bytes through the shuffles, not their shingles.

What is stored on the way is deleted as soon as nothing reads it any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import (
    LOWER, NOT_SPACE, WordHash, chunks, find_words, given_up, inside_rows, row_id, stored, user_id, window_hash,
)
from pageloom.operators.graph import connected_components

SHINGLE, NUM, DEN = 5, 4, 5
SEED = 42
#: one text in so many is sampled; shingles in so many sampled texts are common; how many of them are told
SAMPLED, COMMON, TOLD = 16, 3, 500_000
#: shingles for each word of a sketch
SKETCHED = 4


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words are those of bytes.lower and bytes.split."""
    words = WordHash(SEED)
    for _, _, buf, offs in chunks(column):
        starts, ends, first = find_words(LOWER[buf], offs, NOT_SPACE)
        h = words(LOWER[buf], starts, ends)
        w = window_hash(h, SHINGLE)
        whole = inside_rows(first, SHINGLE, len(h))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                yield np.unique(w[a:b - SHINGLE + 1][whole[a:b - SHINGLE + 1]])
            else:
                yield window_hash(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _node(found: np.ndarray) -> int:
    """One number for a set."""
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _list(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    at = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of distinct hashes, as 64-bit words; their number is a power of two, 16 to 32 bits a hash.

    The place of a hash is its lowest bits, so the two halves of a bitmap, one over the
    other, are the bitmap of half the words.
    """
    words = 1 << max(0, -(-len(hashes) // SKETCHED) - 1).bit_length()
    bits = np.zeros(words * 64, np.uint8)
    bits[((hashes ^ (hashes >> np.uint64(32))) & np.uint64(words * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _marks(common: np.ndarray, rank: np.ndarray) -> Callable:
    """(_id, _tag, text) -> (_id, _tag, node, n, prefix, sketch); ``common`` are sorted hashes that come last, by their rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prefixes = [], [], []
            for found in shingle_sets(batch.column("text")):
                n = len(found)
                nodes.append(_node(found))
                sizes.append(n)
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    late = common[at] == found
                    found = np.concatenate((found[~late], found[late][np.argsort(rank[at[late]])]))
                prefixes.append(found[:_length(n)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_tag"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                 _list(prefixes), _list([sketch(p) for p in prefixes])],
                names=["_id", "_tag", "node", "n", "prefix", "sketch"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("node"), _list(list(shingle_sets(batch.column("text"))))], names=["node", "found"])


def _length(n):
    """Shingles in the prefix of n; what lies behind it is too little to be similar."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, node, n, left) in order -> the rows whose h is not alone, with node, n and left of the row before under one h.

    The first and the last row of a partition are given in any case: their h may go on in another.
    """
    names = ["h", "node", "n", "left"]
    last, priors, before = [np.zeros(0, np.int64)] * 4, None, True

    def rows(columns, priors, at):
        none = priors[0][at] == columns[1][at]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c[at]) for c in columns), *(pa.array(p[at], mask=none) for p in priors)], names=[*names, "to", "m", "rest"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.concatenate((x, batch.column(c).to_numpy())) for x, c in zip(last, names)]
        h, node = columns[:2]
        same = h[1:] == h[:-1]
        near = np.concatenate(([before], same))  # with the row before
        priors = [np.concatenate((c[:1] if priors is None else p, np.where(same, c[:-1], c[1:])))
                  for c, p in zip(columns[1:], priors or columns[1:])]
        yield rows(columns, priors, np.flatnonzero(near[:-1] | same))
        last, priors, before = [c[-1:] for c in columns], [p[-1:] for p in priors], bool(near[-1])
    if priors is not None:
        yield rows(last, priors, np.zeros(1, np.int64))


def _behind(n: str) -> Column:
    """Shingles of a set of n that are not in its prefix."""
    return F.expr(f"{n} - ({n} - ({NUM} * {n} + {DEN - 1}) div {DEN} + 1)")


def _hopeful(common: Column) -> Column:
    """Whether sets of n and m whose prefixes have so many in common can be similar."""
    return (NUM + DEN) * (common + F.greatest(_behind("n"), _behind("m"))) >= NUM * (F.col("n") + F.col("m"))


def _halved(words: Column) -> Column:
    half = F.floor(F.size(words) / 2).cast("int")
    return F.zip_with(F.slice(words, 1, half), F.slice(words, half + 1, half), lambda v, w: v.bitwiseOR(w))


def at_most_common(n: Column, x: Column, y: Column) -> Column:
    """What a prefix of a set of n, with the sketch x, can have in common with one of the sketch y.

    Sets that similar have sketches of one length or of twice the other's.
    """
    short = F.least(F.size(x), F.size(y))
    fit = lambda v: F.when(F.size(v) > short, _halved(v)).otherwise(v)
    own = F.aggregate(F.zip_with(fit(x), fit(y), lambda v, w: F.bit_count(v.bitwiseAND(F.bitwise_not(w)))), F.lit(0), lambda s, c: s + c)
    return n - _behind("n") - F.when(F.greatest(F.size(x), F.size(y)) <= 2 * short, own).otherwise(0)


def _sizes_allow(n: Column, m: Column) -> Column:
    return F.least(n, m) * DEN >= F.greatest(n, m) * NUM


def near_texts(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable), a row per input row.

    A null text counts as empty; texts without a word are alike.  A null doc_id stands
    before all others and its component_id is null.  Rows with one doc_id have each
    their own text.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(row_id().alias("_id"), F.xxhash64(text).alias("_tag"), text.alias("text"))
    sampled = texts.where(F.pmod(F.xxhash64("_tag"), F.lit(SAMPLED)) == 0).dropDuplicates(["_tag"]).withColumnRenamed("_tag", "node")
    often = sampled.select("node", "text").mapInArrow(_sets, "node long, found array<long>").select(
        F.explode("found").alias("h")).groupBy("h").count().where(F.col("count") >= COMMON)
    told = often.orderBy(F.desc("count"), "h").limit(TOLD).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(told)
    # the commonest has the last rank
    marks = stored(texts.mapInArrow(
        _marks(told[order], -order), "_id long, _tag long, node long, n long, prefix array<long>, sketch array<long>"))
    # copies have equal prefixes; any row of the least (_id, _tag) has a text of the set
    whole = stored(marks.groupBy("node").agg(
        F.min("_id").alias("least"), F.min(F.struct("_id", "_tag")).alias("row"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")))
    ids = stored(marks.select("_id", "node"))
    given_up(marks)
    # in the order of shingles and sizes; a shingle of very many points is cut anywhere
    order = ["h", "n", "node"]
    placed = whole.select(F.posexplode("prefix").alias("i", "h"), "node", "n").select("h", "node", "n", (F.col("n") - F.col("i")).alias("left"))
    shared = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _shared, "h long, node long, n long, left long, to long, m long, rest long"))
    points = stored(whole.drop("prefix"))
    given_up(whole)
    sketches = points.select("node", "n", "sketch")

    def sides(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """Both points of pairs (a, b): sizes n and m, and x and y.  Compared row by row in the JVM, never in batches."""
        return pairs.join(of.toDF("a", "n", "x"), "a").join(of.toDF("b", "m", "y"), "b")

    def linked(pairs: DataFrame) -> DataFrame:
        """The similar ones of different candidate pairs (a, b)."""
        pairs = stored(pairs)
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        rows = stored(points.select("node", "row._id", "row._tag").join(nodes, "node", "left_semi"))
        found = stored(texts.join(rows, ["_id", "_tag"]).dropDuplicates(["node"]).select("node", "text").mapInArrow(
            _sets, "node long, found array<long>"))
        both = F.size(F.array_intersect("x", "y"))
        links = stored(sides(pairs, found.select("node", F.size("found"), "found")).where(
            (NUM + DEN) * both >= NUM * (F.col("n") + F.col("m"))).select("a", "b"))
        given_up(pairs, rows, found)
        return links

    def compared(pairs: DataFrame) -> DataFrame:
        """The similar ones of pairs (a, b), of sizes that allow it, that may repeat."""
        return linked(sides(pairs.distinct(), sketches).where(
            _hopeful(at_most_common(F.col("n"), F.col("x"), F.col("y")))).select("a", "b"))

    # two sets share no more than stands before the shingle in both, and from there on in both
    most = F.least(F.col("n") - F.col("left"), F.col("m") - F.col("rest")) + F.least("left", "rest")
    near = compared(shared.where(F.col("to").isNotNull() & ((NUM + DEN) * most >= NUM * (F.col("n") + F.col("m")))).select(
        F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")))
    # what is still apart under one shingle, across components
    apart = shared.join(connected_components(near), "node", "left").select("h", "node", "n", "left", F.coalesce("component", "node").alias("c"))
    mixed = apart.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("h")
    apart = stored(apart.join(mixed, "h"))
    given_up(shared)
    other = apart.select("h", F.col("node").alias("to"), F.col("n").alias("m"), F.col("left").alias("rest"), F.col("c").alias("d"))
    enough = (NUM + DEN) * F.least("left", "rest") >= NUM * (F.col("n") + F.col("m"))
    across = apart.join(other, "h").where(
        (F.col("c") != F.col("d")) & (F.col("node") < F.col("to")) & _sizes_allow(F.col("n"), F.col("m")) & enough)
    links = near.unionByName(compared(across.select(F.col("node").alias("a"), F.col("to").alias("b"))))
    given_up(apart)

    named = connected_components(links).join(points.select("node", "least"), "node")
    roots = named.groupBy("component").agg(F.min("least").alias("_least"))
    of = points.select("node", "least").join(named.join(roots, "component").select("node", "_least"), "node", "left").select(
        "node", F.coalesce("_least", "least").alias("component"))
    return ids.join(of, "node").select(
        user_id("_id").alias("doc_id"), user_id("component").alias("component_id"))
