"""Token alignment against one token at a time."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pageloom.llm import alignment
from tests.llm.conftest import edge_rows

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")

ODD = ["<|endoftext|> and </s><s><unk><0x41>", "  two  spaces \n\n tabs\t\t", "don't can't we'll", "\u0000\u0001 controls", "½ ﬁ Å ① ㎏ Ａ", "naïve café 漢字仮名 😀👩‍👩‍👧",
       "▁under ▁ bar", "a", " ", "a b " * 500, "٣٤ ​ x   y", "é", "﷽", "\r\nline\r"]


def by_hand(texts):
    """n_a, n_b, groups, links of each text."""
    tokens = alignment._tokens(*alignment.paths())
    sizes = [[len(t) for t in side.tokens.to_pylist()] for side in tokens.sides]
    names = [side.tokens.to_pylist() for side in tokens.sides]
    for text in texts:
        text = text or ""
        a = tokens.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tokens.b.encode(text) if text else []
        want = (" " + text).encode()
        if not text or b"".join(names[0][i] for i in a) != want or b"".join(names[1][i] for i in b) != want:
            yield 0, 0, [], []
            continue
        ends = [set(), set()]
        for s, ids in enumerate((a, b)):
            at = 0
            for i in ids:
                at += sizes[s][i]
                ends[s].add(at)
        both = ends[0] & ends[1]
        cut = [[[]], [[]]]
        for s, ids in enumerate((a, b)):
            at = 0
            for i in ids:
                cut[s][-1].append(i)
                at += sizes[s][i]
                if at in both:
                    cut[s].append([])
        groups = list(zip(cut[0][:-1], cut[1][:-1]))
        yield len(a), len(b), groups, [(x[-1], y[-1]) for x, y in groups]


def want_rows(rows):
    done = list(by_hand([t for _, t in rows]))
    counts = Counter(link for *_, links in done for link in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = Counter()
    for (d, _), (n_a, n_b, groups, links) in zip(rows, done):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[(d, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(text.encode()).hexdigest() if n_a else "")] += 1
    return out


@pytest.mark.parametrize("memo", [3, alignment.MEMO])
def test_alignment(spark, tmp_path, memo, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", memo)
    rows = [*edge_rows(), *((300 + i, t) for i, t in enumerate(ODD)), (300, ODD[0])]
    want = want_rows(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text")
    docs = docs.withColumns({c: F.lit("clash") for c in ("_id", "n_a", "groups", "pairs", "times", "pair", "n")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op12_tokenizer_alignment(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == want
    assert sum(r.n_groups for r in got) > 1_000 and any(r.n_a == 0 for r in got if r.doc_id and r.doc_id >= 300)


def test_counts_and_bound(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, "two three")], "doc_id long, text string")
    counts = {r.pair: r.n for r in alignment.pair_counts(alignment.align(docs)).collect()}
    assert Counter(counts.values()) == Counter({1: 2, 3: 1})
    assert len(counts) <= alignment._tokens(*alignment.paths()).most_pairs() < 1_200_000


def test_parts_are_whole_texts(spark, monkeypatch):
    """Words tokenized one by one give the ids of whole texts; a full memory forgets nothing."""
    monkeypatch.setattr(alignment, "MEMO", 500)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD
    got = alignment._align_texts(alignment._Tokens(*alignment.paths()), [t or "" for t in texts])
    for i, (n_a, n_b, groups, _) in enumerate(by_hand(texts)):
        assert (got["n_a"][i].as_py(), got["n_b"][i].as_py()) == (n_a, n_b)
        assert got["groups"][i].as_py() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def test_empty_table(spark, no_docs):
    aligned = alignment.align(no_docs)
    assert alignment.score_links(aligned, alignment.pair_counts(aligned)).count() == 0
