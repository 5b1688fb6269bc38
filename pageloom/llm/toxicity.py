"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the hashed words, pairs of neighbours and pairs with one
word between (skip-grams); a feature counts once however often it occurs.  FTRL
keeps a learning rate per coordinate, and its L1 term leaves most weights at zero,
so what tasks receive is a few thousand numbers and at most ``DIMENSIONS``.

Learning takes a bounded sample of labelled rows (``sample`` rows, by the order of
a hash of their ids, so the choice is the same on every run).  The sample's ids are
few enough to broadcast; features are made where the texts are, and one task runs
through the sample's features.  Scoring reads every whole text once, where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import (
    LOWER, WORD_BYTES, WordHash, chunks, find_words, inside_rows, mix, row_id, table,
)

#: hashed features; also the bound of the weights that are broadcast
DIMENSIONS = 1 << 20
#: labelled rows that a model is fitted on, at most
SAMPLE = 16_000
HELD_OUT = 5


def _grams(h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word positions, feature numbers) of words, pairs and skip-grams."""
    n, top = len(h), np.uint64(64 - int(DIMENSIONS).bit_length() + 1)
    yield np.arange(n), (mix(h) >> top).astype(np.int32)
    for gap in (1, 2):
        at = np.flatnonzero(inside_rows(first, gap + 1, n))
        pair = h[at] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * gap) + h[at + gap]
        yield at, (mix(pair) >> top).astype(np.int32)


def _words(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, first word of each row), long texts included whole."""
    hasher = WordHash(71)
    for lo, hi, buf, offs in chunks(column):
        buf = LOWER[buf]
        starts, ends, first = find_words(buf, offs, WORD_BYTES)
        yield lo, hi, hasher(buf, starts, ends), first


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, toxic, text) -> (place, toxic, features): distinct feature numbers, sorted."""
    for batch in batches:
        rows = []
        for _, _, h, first in _words(batch.column("text")):
            of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            keys = np.unique(np.concatenate([of[at] * DIMENSIONS + g for at, g in _grams(h, first)]))
            cut = np.searchsorted(keys, np.arange(1, len(first) - 1) * DIMENSIONS)
            rows += [pa.array((k % DIMENSIONS).astype(np.int32)) for k in np.split(keys, cut)]
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.concat_arrays(rows) if rows else pa.array([], pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), lists], names=["place", "toxic", "features"])


class Ftrl:
    """FTRL-proximal logistic regression on sparse 0/1 features; the last weight is the bias."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, DIMENSIONS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _train(epochs: int) -> Callable:
    """The sample's features, in order of place, -> (feature, weight) that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, x.values.to_numpy()) for b in batches for t, x in zip(b.column("toxic").to_pylist(), b.column("features"))]
        model = Ftrl()
        for _ in range(epochs):
            for label, at in rows:
                model.learn(at, label)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["feature", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = 4) -> np.ndarray:
    """Weights (DIMENSIONS and the bias).  ``labels``: doc_id, toxic.

    Several labels of one doc_id count as toxic if one of them does; null labels
    and ids without a text teach nothing.  Of several texts of one doc_id the one with
    the least hash teaches.  Without any label every weight is zero.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max("toxic").cast("int").alias("toxic"))
    chosen = known.withColumn("place", F.xxhash64("_id")).orderBy("place", "_id").limit(sample)
    # ids may repeat: one text of each, so at most `sample` rows reach the one task
    texts = docs.select(row_id().alias("_id"), "text").join(F.broadcast(chosen), "_id").groupBy("_id", "place", "toxic").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    features = texts.select("place", "toxic", "text").mapInArrow(_features, "place long, toxic int, features array<int>")
    learned = features.repartition(1).sortWithinPartitions("place", "toxic", "features").mapInArrow(
        _train(epochs), "feature int, weight double").toPandas()
    w = np.zeros(DIMENSIONS + 1)
    w[learned["feature"]] = learned["weight"]
    return w


def _score(at: np.ndarray, values: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(DIMENSIONS + 1)
        w[at] = values
        for batch in batches:
            out = []
            for _, _, h, first in _words(batch.column("text")):
                of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                hits = []
                for p, g in _grams(h, first):
                    some = np.flatnonzero(w[g])
                    hits.append(of[p[some]] * DIMENSIONS + g[some])
                keys = np.unique(np.concatenate(hits))  # a feature counts once per text
                sums = np.bincount(keys // DIMENSIONS, weights=w[keys % DIMENSIONS], minlength=len(first) - 1)
                out.append(1 / (1 + np.exp(-np.clip(sums + w[DIMENSIONS], -35, 35))))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "_score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns and ``_score`` (0 to 1) of every row; null and empty texts get the bias's score.

    Rows are scored one by one, repeated or not; other columns are ignored.
    """
    at = np.flatnonzero(weights)
    picked = docs.select(*dict.fromkeys([*columns, "text"]))
    return picked.mapInArrow(_score(at, weights[at]), picked.withColumn("_score", F.lit(0.0)).schema).select(*columns, "_score")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """A fifth of the ids, never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % HELD_OUT == 0, F.lit(False))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"))
