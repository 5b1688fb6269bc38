"""The pipeline's near-duplicate stage against brute-force Jaccard pairs."""

from __future__ import annotations

from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import jaccard
from pageloom.skew import shared_folder
from tests.llm.conftest import edge_rows
from tests.llm.test_text_operators import brute_components

NULL = -(2**63)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def planted():
    """Texts of 120 words and near copies with one to six changed words; a large group; texts that share a passage."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"v{i}" for i in rng.integers(5_000, size=n)]
    texts = []
    for changed in (1, 2, 3, 4, 5, 6):
        for _ in range(3):
            base = word(120)
            copy = list(base)
            for at in rng.choice(120, changed, replace=False):
                copy[at] = "changed"
            texts += [" ".join(base), " ".join(copy)]
    hot = word(150)
    texts += [" ".join([*hot[:i], f"own{i}", *hot[i + 1:]]) for i in range(40)]
    shared = word(60)
    texts += [" ".join([*shared, *word(40 + i)]) for i in range(30)]
    return [(100 + i, t) for i, t in enumerate(texts)]


def want_components(rows):
    least = {}
    for d, text in rows:
        s = shingles(text)
        least[s] = min(least.get(s, 2**63), NULL if d is None else d)
    component = brute_components(least, similar)
    return Counter((d, None if component[shingles(t)] == NULL else component[shingles(t)]) for d, t in rows)


def test_near_texts(spark, no_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLED", 2)  # the tasks' order of shingles is then not that of the hashes alone
    rows = [*edge_rows(), *planted()]
    want = want_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r.doc_id, r.component_id) for r in jaccard.near_texts(docs).collect()) == want
    assert sum(d != c for d, c in want if d and d >= 100) >= 45
    assert jaccard.near_texts(no_docs).count() == 0


def test_stage_drops_near_copies(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    assert left == {d for d, c in want_components(rows) if d == c}


def test_stage_drops_what_fingerprints_link(spark):
    """A repeated passage makes equal fingerprints; the sets of five words differ by the ends."""
    ends = [[f"{c}{i}" for i in range(12)] for c in "ab"]
    rows = [(i, " ".join(["one", "two", "three"] * 100 + end)) for i, end in enumerate(ends)] + [(2, "quite another text")]
    assert not similar(shingles(rows[0][1]), shingles(rows[1][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()} == {0, 2}


def test_sketches_never_hide_a_common_shingle(spark):
    """The bound from two sketches, of one length or of twice the other's, is never below what the prefixes share."""
    rng = np.random.default_rng(7)
    rows, want = [], []
    for at in range(200):
        n = int(rng.integers(1, 400))
        m = int(rng.integers(max(1, n * 4 // 5), n * 5 // 4 + 1))
        a, b = jaccard._length(n), jaccard._length(m)
        both = int(rng.integers(0, min(a, b) + 1))
        found = np.unique(rng.integers(0, 2**64, 2 * (a + b), dtype=np.uint64))
        rng.shuffle(found)
        x, y = found[:a], np.concatenate((found[:both], found[a:a + b - both]))
        rows.append((at, n, m, *(jaccard.sketch(v).view(np.int64).tolist() for v in (x, y))))
        want.append(both)
    df = spark.createDataFrame(rows, "at long, n long, m long, x array<long>, y array<long>")
    got = [r.most for r in df.select("at", jaccard.at_most_common(F.col("n"), F.col("x"), F.col("y")).alias("most")).orderBy("at").collect()]
    assert all(g >= w for g, w in zip(got, want))
    # and it tells nearly as much as the prefixes would
    assert np.mean([g - w <= 2 + 0.1 * jaccard._length(r[1]) for g, w, r in zip(got, want, rows)]) > 0.9


def test_intermediate_tables_are_deleted(spark):
    folder = Path(urlparse(shared_folder(spark)).path)
    before = {p.name for p in folder.glob("stored-*")}
    docs = spark.createDataFrame(planted(), "doc_id long, text string")
    near = jaccard.near_texts(docs)
    left = [p for p in folder.glob("stored-*") if p.name not in before]
    names = [set(spark.read.parquet(str(p)).columns) for p in left]
    assert sorted(map(sorted, names)) == [["_id", "node"], ["a", "b"], ["a", "b"], ["least", "n", "node", "row", "sketch"]]
    assert near.count() == len(planted())
