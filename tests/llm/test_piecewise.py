"""Piecewise fingerprints against a walk over single bytes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.llm import piecewise
from pageloom.llm.common import chunks, mix
from tests.llm.conftest import edge_rows


def mixed(x):
    return int(mix(np.array([x % 2**64], np.uint64))[0])


def brute(text):
    """The fingerprint of a text, a byte at a time."""
    data = (text or "").encode()
    hashes = []
    for i in range(len(data)):
        hashes.append(mixed(sum(int(piecewise._BYTE[data[i - k]]) * pow(0x9E3779B97F4A7C15, k, 2**64)
                                for k in range(min(piecewise.ROLL, i + 1)))))
    ones = [len(bin(x)) - len(bin(x).rstrip("1")) for x in hashes]
    k = 1
    while sum(o >= k for o in ones) >= piecewise.CHUNKS:
        k += 1
    signs = []
    for level in range(k, k + piecewise.SIZES):
        sign, total = "", 0
        for i, x in enumerate(hashes):
            total += x
            if ones[i] >= level or i == len(data) - 1:
                sign, total = sign + chr(piecewise.ALPHABET[mixed(total) >> 58]), 0
        signs.append(sign)
    return ":".join([str(k), *signs])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(row[j] if x == y else 1 + min(row[j + 1], new[j]))
        row = new
    return row[-1]


def alike(a, b):
    run = max(2, min(piecewise.RUN, min(len(a), len(b)) // 2))
    if not any(a[i:i + run] in b for i in range(len(a) - run + 1)):
        return 0.0
    return 1 - distance(a, b) / (len(a) + len(b))


def likeness(a, b):
    if a == b:
        return 1.0
    (k, *x), (m, *y) = a.split(":"), b.split(":")
    at, to = ({int(j) + i: sign for i, sign in enumerate(signs)} for j, signs in ((k, x), (m, y)))
    return max((alike(at[s], to[s]) for s in at.keys() & to.keys()), default=0.0)


def test_fingerprints_of(monkeypatch):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    texts = ["", None, "a", "ab", "aaaa" * 300, "", words(700), "é漢字" * 40, "", "x", words(3), words(2000), ""]
    want = [brute(t) for t in texts]
    assert piecewise.fingerprints_of(pa.array(texts)) == want
    monkeypatch.setattr(piecewise, "BLOCK", 501)  # texts in many blocks
    assert piecewise.fingerprints_of(pa.array(texts)) == want
    (_, _, buf, offs), = chunks(pa.array(texts), 1 << 20)
    assert piecewise._signatures(buf, offs) == want
    assert all(len(w.split(":")[1]) <= piecewise.CHUNKS for w in want)


def test_likeness():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcde") for _ in range(rng.randrange(40))) for _ in range(2))
        assert piecewise._distance(a, b) == distance(a, b)
        marks = f"4:{a}:{b[:9]}:{a[:5]}", f"{rng.choice([1, 2, 3, 4, 5, 6, 7])}:{b}:{a[3:]}:{b[4:]}"
        assert piecewise.likeness(*marks) == pytest.approx(likeness(*marks))
    text = " ".join(f"v{rng.randrange(3000)}" for _ in range(900))
    other = " ".join(f"u{rng.randrange(3000)}" for _ in range(900))
    near = piecewise.fingerprints_of(pa.array([text, "new head " + text, text[:2500] + other[:2000], other]))
    assert piecewise.likeness(near[0], near[1]) > 0.9 and piecewise.likeness(near[0], near[2]) > 0.35
    assert piecewise.likeness(near[0], near[3]) == 0


@pytest.mark.parametrize("rows_each", [3, 16_384])
def test_edits_with_next(spark, edge_docs, no_docs, monkeypatch, rows_each):
    monkeypatch.setattr(piecewise, "ROWS", rows_each)
    tags = {r.text: r.t for r in edge_docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).distinct().collect()}
    rows = sorted(((-(2**63) if d is None else d, tags[t], t or "") for d, t in edge_rows()), reverse=True)
    want = Counter()
    for a, b in zip(rows, rows[1:] + rows[:1]):
        text, after = a[2], b[2]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        mark, mark_e = brute(text), brute(edited)
        want[(None if a[0] == -(2**63) else a[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, mark_e,
              round(likeness(mark, mark_e), 9), round(likeness(mark, brute(after)), 9))] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                  for r in piecewise.edits_with_next(edge_docs).collect())
    assert got == want
    assert piecewise.edits_with_next(no_docs).count() == 0
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in piecewise.fingerprints(edge_docs).collect()) == Counter(
        (d, len(t or ""), brute(t)) for d, t in edge_rows())
    pairs = piecewise.fingerprints(edge_docs).select(piecewise.likeness_of("fingerprint", "fingerprint").alias("one")).distinct().collect()
    assert [r.one for r in pairs] == [1.0]
