"""Retrieval of the packing operator, without a shortcut."""

from __future__ import annotations

import numpy as np
import pytest

from pageloom.llm import packing


def piece(rng, low, high, length):
    which, count = np.unique(rng.integers(low, high, size=length), return_counts=True)
    return (which * packing.COUNTS + count).astype(np.int32)


def by_hand(lengths, packed, model, window):
    """The same rule, a pair at a time."""
    terms = [dict(zip(*(x.tolist() for x in model.weigh(p, n)))) for p, n in zip(packed, lengths)]
    free, groups = set(range(len(lengths))), []
    while free:
        seed = min(free, key=lambda i: (-lengths[i], i))
        free.remove(seed)
        group, room = [seed], window - lengths[seed]
        score = {i: round(sum(w for t, w in terms[i].items() if t in terms[seed]), 9) for i in free}
        for i in sorted((i for i in free if score[i] > 0), key=lambda i: (-score[i], i)):
            if lengths[i] <= room:
                group.append(i)
                room -= lengths[i]
        free -= set(group)
        while fitting := [i for i in free if lengths[i] <= room]:
            i = min(fitting, key=lambda i: (-lengths[i], i))
            free.remove(i)
            group.append(i)
            room -= lengths[i]
        groups.append(group)
    return groups


def test_all_neighbours_before_size():
    rng = np.random.default_rng(2)
    lengths = [30] * 60 + [40] * 60 + [int(x) for x in rng.integers(5, 900, size=60)]
    packed = [piece(rng, *((2, 40) if i < 60 else (300, 600) if i < 120 else (600, 4_000)), n) for i, n in enumerate(lengths)]
    frequency = np.bincount(np.concatenate([p // packing.COUNTS for p in packed]), minlength=4_000)
    model = packing.Bm25(frequency, len(lengths), float(np.mean(lengths)))
    assert packing.pack_shard(lengths, packed, model, 2048) == by_hand(lengths, packed, model, 2048)
    # short texts of one source: the window of the first holds them all, none of another source
    (group,) = [g for g in packing.pack_shard([31, *[30] * 59, *[20] * 40], [packed[0], *packed[1:60], *packed[60:100]], model, 1801)
                if 0 in g]
    assert sorted(group) == list(range(60))


def test_statistics_count_every_piece(spark, monkeypatch):
    pytest.importorskip("tokenizers")
    made = []
    real = packing.Bm25
    monkeypatch.setattr(packing, "Bm25", lambda *a: made.append(a) or real(*a))
    docs = spark.createDataFrame([(1, "word " * 300), (2, "other")], "doc_id long, text string")
    rows = packing.pack(docs, window=64).collect()
    (frequency, pieces, mean), = made
    assert len(rows) == pieces == 6 and mean == pytest.approx(sum(r.length for r in rows) / 6)
    assert frequency.max() == 5  # "word", in each piece of the long document


def test_other_tokenizers_read_whole_texts():
    """White space is a token there, so words do not give the ids of texts."""
    import public_tokenizers
    import pyarrow as pa

    for name, whole in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        ids = packing.Ids(public_tokenizers.path(name))
        assert ids.whole is whole
        texts = ["Some words,  and\nmore", None, "", "漢字 é"]
        got, at = ids.of(pa.array(texts))
        assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [
            ids.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_marks_after_words_are_words_of_their_own():
    """They were looked up with the word before them, so each such pair was tokenized anew."""
    import public_tokenizers
    import pyarrow as pa

    texts = ["word*** word!! Éß,", "12%% it's' a<|endoftext|>!! x×!", "no", None, "-" * 40 + " a" + "!" * 30]
    data, ends, first = packing._words(pa.array(texts))
    raw, ends = data.tobytes(), ends.tolist()
    words = [raw[a:b].decode() for a, b in zip([0, *ends], ends)]
    assert words[:6] == ["word", "***", "word", "!!", "Éß", ","] and first.tolist()[:2] == [0, 6]
    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):  # learned, then remembered
        got, at = ids.of(pa.array(texts))
        assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [
            ids.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_are_forgotten_beyond_the_limit(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHE", 50)
    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    for lo in range(0, 200, 20):
        texts = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}x{'uv'[i // 100]} the" for i in range(lo, lo + 20)]
        got, at = ids.of(pa.array(texts))
        assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [
            ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(ids.known) <= 50 and (ids.known[1:] > ids.known[:-1]).all()
