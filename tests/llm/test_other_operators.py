"""Chats, toxicity, vectors, the SQL twins and the pipeline."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import compare, connect
from pageloom.llm import chat, toxicity, vectors
from pageloom.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import edge_rows
from tests.llm.test_jaccard import want_components
from tests.llm.test_text_operators import brute_components

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, name):
    note = compare(connect(SMALL), spark, name, SMALL, QUERIES, ORACLE)
    assert not note or note.startswith("note"), note


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>user\nhi", "\\s \\l \\n \\", "<", "|im_end|>", "", None, "a\nb", "<|image|>", "漢字 <<|"]
    part = lambda t: ("text", t, None, None)
    rows = [(1, i, "assistant" if i % 2 else "us\ner<|", [part(x)]) for i, x in enumerate(odd)]
    rows += [(2, 0, "user", [part("<"), part("|im_end|>"), ("image", None, "s3://a.png", None), ("audio", None, "b", 9), ("odd", "x", None, None)]),
             (2, 1, None, None), (2, 1, None, None), (None, None, "assistant", [part("no id")]), (None, 3, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("piece", F.lit("clash"))
    formatted = chat.format_chats(df)
    back = chat.read_back(formatted).collect()
    text = lambda ps: "".join(p[1] or "" for p in ps or () if p[0] not in chat.ATTACHMENTS)
    got = Counter((r.conv_id, r.role, r.text) for r in back)
    assert got == Counter((c, role or "", text(ps)) for c, _, role, ps in rows)
    assert all((r.role == "assistant") == bool(r.learned) for r in back)
    one = {r.conv_id: r for r in formatted.collect()}
    assert [tuple(a) for a in one[2].attachments] == [("image", "s3://a.png", 256), ("audio", "b", 9)] and one[2].expanded_tokens == 265
    spans = [one[1].formatted[s.start:s.start + s.length] for s in one[1].loss_spans]
    assert [x.replace("\\l", "<").replace("\\s", "\\") for x in spans] == [x or "" for x in odd[1::2]]
    assert chat.format_chats(df.where("false")).count() == 0


def test_toxicity(spark, edge_docs, no_docs):
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(600):
        w = list(rng.choice(words, size=40))
        if i % 5 == 0:
            w[3] = "vile"
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").where("doc_id % 3 > 0").unionByName(
        spark.createDataFrame([(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int"))
    w = toxicity.fit(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r._score for r in toxicity.score(docs, w).collect()}
    right = [(got[i] >= 0.5) == bool(t) for i, _, t in rows if i % 3 == 0]
    assert np.mean(right) > 0.97
    assert toxicity.score(edge_docs, w).count() == len(edge_rows())
    assert all(0 <= r._score <= 1 and not math.isnan(r._score) for r in toxicity.score(edge_docs, w).collect())
    assert toxicity.score(no_docs, w).count() == 0
    assert not toxicity.fit(docs, labels.where("false")).any()
    assert np.array_equal(w, toxicity.fit(docs.repartition(7), labels.repartition(5)))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = toxicity_rows = QUERIES["op7_toxicity"](spark, folder).where("held_out")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity_rows.join(labels, "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert got.count() > 1500 and right > 0.95


@pytest.mark.parametrize("chunk", [3, 2000])
def test_vectors(spark, chunk):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    data = [list(map(float, b + 0.12 * rng.normal(size=16))) for b in base for _ in range(6)]
    data += [data[0], data[0], [x * 3 for x in data[7]], [0.0] * 16, [-0.0] * 16, None, [], [float("nan")] + [1.0] * 15, [float("inf")] * 16,
             [None] + [1.0] * 15, data[3][:9], [1e200 * x for x in data[2]]]
    rows = [(i, v) for i, v in enumerate(data)] + [(3, data[3]), (None, data[40]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({c: F.lit("clash") for c in ("cid", "v", "near")})

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.zeros(16)
        x[:len(v)] = np.array(v) / np.abs(v).max()
        return x / np.linalg.norm(x)

    u = [unit(v) for _, v in rows]
    ids = [-(2**63) if i is None else i for i, _ in rows]
    near = lambda a, b: u[a] is not None and u[b] is not None and u[a] @ u[b] >= 0.95
    comp = brute_components(dict(enumerate(ids)), near)
    want = Counter()
    for n, (i, _) in enumerate(rows):
        c = comp[n]
        want[(i, sum(near(n, m) for m in range(len(rows)) if m != n), None if c == -(2**63) else c, ids[n] == c)] += 1
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicate_vectors(df, nearest=6, chunk=chunk).collect())
    assert got == want
    assert vectors.near_duplicate_vectors(df.where("false")).count() == 0


def test_vector_recall(spark):
    """At least nine in ten of the links that brute force finds."""
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op8_embedding_dedup"](spark, folder).agg(F.sum("n_links")).first()[0]
    x = np.stack(spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    exact = int((x @ x.T >= 0.95).sum() - len(x))
    assert 0.9 * exact <= got <= exact


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        rows = after.collect()
        assert {r.doc_id for r in rows} <= set(before)
        gone = set(before) - {r.doc_id for r in rows}
        if name == "toxicity":
            scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet").where(~toxicity.held_out())))
            assert gone == {r.doc_id for r in scored.collect() if r._score >= 0.5}
        elif name == "line_dedup":
            assert not gone and all(r.n_chars == len(r.text) for r in rows)
        elif name == "simhash_dedup":
            assert gone == {d for d, c in want_components(list(before.items())) if d != c}
        else:
            from pageloom.llm.decontaminate import contaminated

            assert gone == {r.doc_id for r in contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect() if r.n_hit}
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, repeated ids and rows, clashing columns and empty tables go through all stages."""
    docs = spark.createDataFrame(edge_rows(), "doc_id long, text string").withColumns(
        {"n_chars": F.length("text").cast("long"), "lang": F.lit("xx")} | {c: F.lit("clash") for c in (
            "kept_text", "n_dropped", "n_lines", "_score", "_rest", "_id", "_tag", "a.b", "item_id", "toxic", "_gone", "node", "component_id")})
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for given in (docs, docs.where("false"), docs.select("text", "doc_id")):
        held, left = given, given.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, held, str(tmp_path))
            assert out.columns == given.columns and out.dtypes == given.dtypes, name
            rows = out.collect()
            assert len(rows) == left if name == "line_dedup" else len(rows) <= left
            if name == "line_dedup" and "n_chars" in given.columns:
                assert all(r.n_chars == (None if r.text is None else len(r.text)) or not r.text for r in rows)
            held, left = spark.createDataFrame(rows, given.schema), len(rows)
        packed = corpus_pipeline.packing(spark, held, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == held.select("doc_id").distinct().count()
    assert left > 10
