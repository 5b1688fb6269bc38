"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its ``nearest`` closest reference points, in order.  Two
vectors are candidates when they share two of them: the inverted lists are kept per
pair of pivots, which is the same as counting shared pivots and asking for two.
Candidates are verified by their cosine in double precision, in blocks of a matrix
product, so that no pair is ever a row.  A pair that meets in several lists counts
only in the first list that both are on.

Pivots come from a bounded sample of distinct vectors, farthest first, so a dense
group cannot take them all; every vector is indexed.  Equal vectors are one entry
with a weight.  A long list is cut into chunks, and every two chunks meet in a task
of their own, so the work of a task is bounded and nothing is left out.

What leaves a task is a number of links per entry and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import row_id, table, user_id
from pageloom.llm.simhash import forest
from pageloom.operators.graph import connected_components
from pageloom.skew import checkpoint

#: distinct vectors that pivots are chosen from, and pivots, at most
SAMPLE, MAX_PIVOTS = 2_048, 1_024
NEAREST = 5
#: entries of a list that meet in one task
CHUNK = 2_000


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that large numbers do not overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice: each pivot is the one least like those before it."""
    like, picked = sample @ sample[0], [0]
    while len(picked) < min(count, len(sample)):
        far = int(np.argmin(like))
        picked.append(far)
        like = np.maximum(like, sample @ sample[far])
    return sample[picked]


def _describe(pivots: np.ndarray, nearest: int) -> Callable:
    """(cid, vector, weight) -> the same with the nearest pivots, by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
            near = []
            for lo in range(0, len(flat), 4096):
                like = _unit(flat[lo:lo + 4096].astype(np.float64)) @ pivots.T
                near.append(np.argsort(-like, axis=1, kind="stable")[:, :nearest])
            near = np.concatenate(near).astype(np.int16)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "near"])

    return run


def _compare(threshold: float) -> Callable:
    """One block of a list: (cid, other, links), forest edges and numbers of links."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bucket, i, j = group["bucket"].iat[0], group["i"].iat[0], group["j"].iat[0]
        x = _unit(np.stack(group["vector"].to_numpy()).astype(np.float64))
        near = np.sort(np.stack(group["near"].to_numpy()).astype(np.int64), axis=1)
        cid, weight, chunk = (group[c].to_numpy() for c in ("cid", "weight", "chunk"))
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        links, edges = np.zeros(len(cid), np.int64), []
        for lo in range(0, len(left), 512):
            rows = left[lo:lo + 512]
            a, b = np.nonzero(x[rows] @ x[right].T >= threshold)
            a, b = rows[a], right[b]
            if i == j:
                less = cid[a] < cid[b]
                a, b = a[less], b[less]
            # the first list that both are on: their two smallest common pivots
            both = (near[a][:, :, None] == near[b][:, None, :]).any(axis=2)
            first = np.argmax(both, axis=1)
            both[np.arange(len(a)), first] = False
            second = np.argmax(both, axis=1)
            at = np.arange(len(a))
            here = near[a][at, first] * MAX_PIVOTS + near[a][at, second] == bucket
            a, b = a[here], b[here]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            if len(a):
                edges.append(forest(cid[a], cid[b]))
        some = np.flatnonzero(links)
        if not len(some):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        u, v = forest(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        return pd.DataFrame({
            "a": np.concatenate([cid[some], u]), "b": np.concatenate([cid[some], v]),
            "links": np.concatenate([links[some], np.zeros(len(u), np.int64)])})

    return run


def pivots_for(entries: int) -> int:
    """About the root of the number of entries, so that lists stay short."""
    return min(MAX_PIVOTS, max(128, 1 << math.ceil(math.log2(max(1.0, 0.9 * math.sqrt(entries))))))


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.95, nearest: int = NEAREST, pivots: int | None = None, chunk: int = CHUNK,
) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row per input row.

    Vectors that are null, empty, zero or hold a null, NaN or infinity link with
    nothing.  Vectors of different lengths are compared as if padded with zeros.
    Repeated ids are separate vectors; a null vec_id stands before all others and
    its component_id is null.  Other columns are ignored.
    """
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = "float" if single else "double"
    e = F.col("embedding").cast(f"array<{kind}>")
    # 128 bits of hash name equal vectors, and their order picks the sample
    fine = F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # adding zero turns -0.0 into 0.0
    rows = vectors.select(row_id("vec_id").alias("_id"), F.transform(e, lambda x: x + F.lit(0).cast(kind)).alias("v")).select(
        "_id", "v", fine.alias("fine"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    good = rows.where("fine")
    width = good.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    padded = F.concat("v", F.array_repeat(F.lit(0).cast(kind), F.lit(width) - F.size("v")))
    entries = checkpoint(good.groupBy("h1", "h2").agg(
        F.first(padded).alias("vector"), F.count(F.lit(1)).alias("weight"), F.min("_id").alias("least"),
    ).withColumn("cid", F.monotonically_increasing_id()))
    n = entries.count()
    sample = [r.vector for r in entries.orderBy("h1", "h2").limit(SAMPLE).select("vector").collect()]
    points = choose_pivots(_unit(np.array(sample, dtype=np.float64)), pivots or pivots_for(n)) if sample else np.zeros((1, width))

    described = checkpoint(entries.select("cid", "weight", "vector").mapInArrow(
        _describe(points, nearest), f"cid long, weight long, vector array<{kind}>, near array<short>"))
    near = F.array_sort("near")
    width_of = min(nearest, len(points))
    pairs = list(combinations(range(width_of), 2)) or [(0, 0)]
    keys = F.array(*[near[a].cast("long") * MAX_PIVOTS + near[b] for a, b in pairs])
    posts = described.withColumn("bucket", F.explode(keys))
    # at most MAX_PIVOTS^2 / 2 lists exist, so the long ones are few enough to broadcast
    long_lists = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select(
        "bucket", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    cut = posts.join(F.broadcast(long_lists), "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
        F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j")))
    met = cut.withColumn("block", F.explode(blocks)).select(
        "bucket", F.col("block.i").alias("i"), F.col("block.j").alias("j"), "chunk", "cid", "weight", "vector", "near")
    found = checkpoint(met.groupBy("bucket", "i", "j").applyInPandas(_compare(threshold), "a long, b long, links long"))

    linked = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    named = connected_components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "cid")
    named = entries.select("cid", "least").join(named, "cid")
    lowest = named.groupBy("component").agg(F.min("least").alias("low"))
    of = entries.select("h1", "h2", "cid", "weight", "least").join(linked, "cid", "left").join(
        named.join(lowest, "component").select("cid", "low"), "cid", "left").select(
        "h1", "h2", F.lit(True).alias("fine"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("low", "least").alias("component"))
    return rows.select("_id", "fine", "h1", "h2").join(of, ["h1", "h2", "fine"], "left").select(
        user_id("_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.coalesce("component", "_id") != -(2**63), F.coalesce("component", "_id")).alias("component_id"),
        (F.col("_id") == F.coalesce("component", "_id")).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: exact; the index may find less where its recall is below one
OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, other) AS (
  SELECT a, b FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT vec_id, min(other) AS m FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN degree USING (vec_id) LEFT JOIN low USING (vec_id)
"""
