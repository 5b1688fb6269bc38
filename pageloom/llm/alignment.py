"""Alignment of the tokens of two tokenizers on whole documents.

Both tokenizers read a text with one space before it: a byte-level one (A) and one of
pieces with byte fallback (B).  Where the bytes of both token sequences are those of the
text, offsets at which a token of A and a token of B end together cut the sequences
into groups, and each such end links the two tokens that end there.

Anchors.  After the full tokenisation, ends that both have before tokens that start with
a space split a document into windows, mostly words.  What a window holds depends on its
token ids alone, so a window is aligned once and remembered by its tuples of ids; its
groups and links are then copied to all places.  Equal windows of a part of a batch are
found together, by their ids written one after another.

Counts.  Linked tokens end together, so the bytes of one are the end of the other's.
Their pairs are thus bounded by the bytes of both vocabularies (twice, as a byte may be
a piece of its own and a byte token), whatever the corpus is; counts over the corpus
are that small table, and every document is scored against it where it lies.

Defined results: a null or empty text, or one that a tokenizer does not give back byte
for byte, has no tokens: zeros and an empty string.  Rows with one doc_id are answered one
by one; a null doc_id stays.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import by_bytes, row_id, table, user_id
from pageloom.skew import shared_folder

BYTES_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: windows of a generation; a worker remembers two
MEMO = 200_000
#: bytes of text tokenized together; bytes of a part of a text that is remembered
PART, REMEMBERED = 1 << 20, 64
#: ids of B stay below this
STRIDE = 1 << 15


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BYTES_FILE), public_tokenizers.path(PIECES_FILE)


def printable_bytes() -> dict[str, int]:
    """Character of a byte-level token -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Side:
    """Bytes of the tokens of one tokenizer."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = pa.array(tokens, pa.large_binary())
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in tokens])
        self.decimal = pa.array(list(map(str, range(len(tokens)))))


class _Tokens:
    """Both tokenizers of a worker, and the windows it remembers."""

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        of, names = printable_bytes(), self.a.get_vocab()
        a_tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            a_tokens[i] = bytes(map(of.get, name)) if of.keys() >= set(name) else name.encode()
        b_tokens = []
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            b_tokens.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode())
        if len(b_tokens) > STRIDE or len(a_tokens) > 1 << 16:
            raise ValueError("ids of a pair do not fit in 31 bits")
        self.sides = _Side(a_tokens), _Side(b_tokens)
        #: no piece has a space after something else, so pieces never reach over one; A splits there by its pattern
        self.cut = not any(b" " in p.lstrip(b" ") for p in b_tokens)
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.old_words: dict[bytes, tuple[bytes, bytes]] = {}
        self.known: dict[bytes, tuple[str, bytes]] = {}
        self.old: dict[bytes, tuple[str, bytes]] = {}

    def most_pairs(self) -> int:
        return 2 * int(sum(side.length.sum() for side in self.sides))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """All ids of A and of B of the texts (one space before each) between ``offs``, and where those of each text begin.

        Texts are cut before every space that follows a printable ASCII character: no token of
        either side reaches over it.  Different parts are tokenized once; short ones are remembered.
        """
        seam = np.zeros(len(buf), bool)
        if self.cut:
            seam[1:] = (buf[1:] == 0x20) & (buf[:-1] > 0x20) & (buf[:-1] < 0x7F)
            seam[offs[1:] - 1] = False  # a part is more than a space
        seam[offs[:-1]] = True
        at = np.flatnonzero(seam)
        parts = pa.Array.from_buffers(pa.large_binary(), len(at), [
            None, pa.py_buffer(np.append(at, len(buf)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        found = self._ids_of(parts.dictionary.to_pylist())
        first, out = np.searchsorted(at, offs), []
        for side in (0, 1):
            copied = pa.array([f[side] for f in found], pa.large_binary()).take(parts.indices)
            _, ends, data = copied.buffers()
            ends = np.frombuffer(ends, np.int64)[:len(copied) + 1] // 4
            flat = np.frombuffer(data, np.int32)[:ends[-1]] if data is not None else np.zeros(0, np.int32)
            out.append((flat.astype(np.int64), ends[first]))
        return out

    def _ids_of(self, parts: list[bytes]) -> list[tuple[bytes, bytes]]:
        found = list(map(self.words.get, parts))
        new = [p for p, f in zip(parts, found) if f is None]
        if len(self.words) + len(new) > MEMO:
            self.words, self.old_words = {}, self.words
        learned = {p: f for p in new if (f := self.old_words.get(p)) is not None}
        unknown = [p for p in new if p not in learned]
        texts = [p.decode() for p in unknown]
        a = [np.array(e.ids, np.int32).tobytes() for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [np.array(ids, np.int32).tobytes() for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]
        learned.update(zip(unknown, zip(a, b)))
        self.words.update((p, f) for p, f in learned.items() if len(p) <= REMEMBERED)
        return [learned[p] if f is None else f for p, f in zip(parts, found)]

    def windows(self, keys: list[bytes]) -> tuple[list[str], list[bytes]]:
        """Groups as text and linked pairs (32 bits each, one a group) of windows, from their ids."""
        found = list(map(self.known.get, keys))
        new = [k for k, f in zip(keys, found) if f is None]
        if len(self.known) + len(new) > MEMO:
            self.known, self.old = {}, self.known
        unknown = []
        for k in new:
            f = self.old.get(k)
            if f is None:
                unknown.append(k)
            else:
                self.known[k] = f
        if unknown:
            self.known.update(zip(unknown, zip(*self._aligned(unknown))))
        found = [self.known[k] if f is None else f for k, f in zip(keys, found)]
        return [f[0] for f in found], [f[1] for f in found]

    def _aligned(self, keys: list[bytes]) -> tuple[list[str], list[bytes]]:
        """The same for windows met for the first time, one after another in one sequence of bytes."""
        width = np.fromiter(map(len, keys), np.int64, len(keys)) // 4
        flat = np.frombuffer(b"".join(keys), np.int32)
        end = np.cumsum(width)
        n_a = flat[end - width].astype(np.int64)
        ids = flat[_ragged(end - width + 1, n_a)], flat[_ragged(end - width + 1 + n_a, width - 1 - n_a)]
        ends = [np.cumsum(side.length[i]) for side, i in zip(self.sides, ids)]
        shared, at_a, at_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        parts = []
        for side, i, at in zip(self.sides, ids, (at_a, at_b)):
            cut = pa.array(np.concatenate(([0], at + 1)).astype(np.int32))
            parts.append(pc.binary_join(pa.ListArray.from_arrays(cut, side.decimal.take(pa.array(i))), ","))
        # both sequences end a window at its last shared end
        last = np.concatenate(([0], np.searchsorted(at_a, np.cumsum(n_a)))).astype(np.int32)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(last), pc.binary_join_element_wise(*parts, "|")), ";")
        links = (ids[0][at_a] * STRIDE + ids[1][at_b]).astype(np.int32).tobytes()
        return text.to_pylist(), [links[lo:hi] for lo, hi in zip((4 * last[:-1]).tolist(), (4 * last[1:]).tolist())]


@cache
def _tokens(byte_path: str, piece_path: str) -> _Tokens:
    """One per Python worker, so that tasks share what was aligned."""
    return _Tokens(byte_path, piece_path)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers starts[i], starts[i] + 1, ... (sizes[i] of them), for all i."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _same_bytes(side: _Side, ids: np.ndarray, first: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which texts are the joined bytes of their tokens."""
    at = np.concatenate(([0], np.cumsum(side.length[ids])))[first]
    data = side.tokens.take(pa.array(ids)).buffers()[2]
    data = memoryview(data if data is not None else b"").cast("B")
    return np.array([data[a:b] == t for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), texts)], bool)


ALIGNED = ("_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>")


def _align_texts(tokens: _Tokens, texts: list[str]) -> dict[str, pa.Array]:
    """Columns of ``ALIGNED`` but _id."""
    raw = [b" " + t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    sides, first = zip(*tokens.encode(np.frombuffer(b"".join(raw), np.uint8), offs))
    same = np.array([bool(t) for t in texts], bool)
    for side, flat, begin in zip(tokens.sides, sides, first):
        same &= _same_bytes(side, flat, begin, raw)
    n = [np.where(same, np.diff(f), 0) for f in first]
    # the texts that count, one after another: their bytes lie at the same offsets on both sides
    ids = [flat[np.repeat(same, np.diff(f))] for flat, f in zip(sides, first)]
    ends = [np.cumsum(side.length[i]) for side, i in zip(tokens.sides, ids)]
    last = [np.cumsum(k[same]) - 1 for k in n]
    marked = []
    for side, i, end, stop in zip(tokens.sides, ids, ends, last):
        anchor = np.append(side.spaced[i[1:]], False) if len(i) else np.zeros(0, bool)
        anchor[stop] = True
        marked.append(end[anchor])
    anchors = np.intersect1d(*marked, assume_unique=True)
    stops = [np.searchsorted(end, anchors) + 1 for end in ends]
    sizes = [np.diff(s, prepend=0) for s in stops]
    # number of A's ids, A's ids, B's ids
    width = 1 + sizes[0] + sizes[1]
    key_end = np.cumsum(width)
    keys = np.empty(int(key_end[-1]) if len(width) else 0, np.int32)
    keys[key_end - width] = sizes[0]
    keys[_ragged(key_end - width + 1, sizes[0])] = ids[0]
    keys[_ragged(key_end - sizes[1], sizes[1])] = ids[1]
    offsets = np.concatenate(([0], 4 * key_end)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(width), [None, pa.py_buffer(offsets), pa.py_buffer(keys)]).dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lines, linked_pairs = tokens.windows(coded.dictionary.to_pylist())
    # windows of each text that counts
    cut = np.concatenate(([0], np.searchsorted(anchors, ends[0][last[0]], "right"))).astype(np.int32)
    words = pa.ListArray.from_arrays(pa.array(cut), pa.array(lines, pa.string()).take(coded.indices))
    joined = pc.binary_join(words, ";").to_pylist()
    groups = [""] * len(texts)
    for row, text in zip(np.flatnonzero(same).tolist(), joined):
        groups[row] = text
    # different pairs of each text, and how often it has them; a group has one
    links = np.frombuffer(b"".join(linked_pairs), np.int32).astype(np.int64)
    many = np.fromiter(map(len, linked_pairs), np.int64, len(linked_pairs)) // 4
    pairs = links[_ragged((np.cumsum(many) - many)[which], many[which])]
    linked = np.zeros(len(texts), np.int64)
    linked[same] = np.diff(np.concatenate(([0], np.cumsum(many[which])))[cut])
    owner = np.repeat(np.arange(len(texts)), linked)
    unique, times = np.unique(owner << 31 | pairs, return_counts=True)
    at = pa.array(np.searchsorted(unique >> 31, np.arange(len(texts) + 1)).astype(np.int32))
    return {
        "n_a": pa.array(n[0]), "n_b": pa.array(n[1]), "n_groups": pa.array(linked), "n_links": pa.array(linked),
        "groups": pa.array(groups, pa.string()),
        "pairs": pa.ListArray.from_arrays(at, pa.array((unique & (1 << 31) - 1).astype(np.int32))),
        "times": pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32))),
    }


def _align(byte_path: str, piece_path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = _tokens(byte_path, piece_path)
        for batch in batches:
            for part in by_bytes(batch, limit=PART):
                columns = _align_texts(tokens, [t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("_id"), *columns.values()], names=["_id", *columns])

    return run


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """A row per input row: _id (see ``row_id``), n_a, n_b, n_groups, n_links, groups, pairs, times.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in decimal ids; ``pairs`` are the different linked
    pairs of the row (a * STRIDE + b), ``times`` how often it has each.
    """
    own = paths() if byte_path is None or piece_path is None else ("", "")
    return docs.select(row_id().alias("_id"), "text").mapInArrow(_align(byte_path or own[0], piece_path or own[1]), ALIGNED)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pairs, times -> (pair, n), once a task; the pairs of two vocabularies are bounded."""
    pair, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for batch in batches:
        more, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
        pair, at = np.unique(np.concatenate((pair, more)), return_inverse=True)
        n = np.bincount(at, np.concatenate((n, times)), len(pair)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(n)], names=["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of all rows hold it."""
    return aligned.select("pairs", "times").mapInArrow(_sums, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _scores(pair: np.ndarray, n: np.ndarray) -> Callable:
    """Adds n_best and count_sum; ``pair`` is sorted."""
    most = np.zeros(STRIDE, np.int64)
    np.maximum.at(most, pair % STRIDE, n)
    best = n == most[pair % STRIDE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            cut = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            sums = [np.concatenate(([0], np.cumsum(x)))[cut] for x in (times * best[at], times * n[at])]
            rest = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), *(pa.array(np.diff(s)) for s in sums)], names=[*rest, "n_best", "count_sum"])

    return run


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows with n_best (links whose pair is the commonest of its id of B) and count_sum in place of their pairs.

    ``counts`` is bounded by the vocabularies (a megabyte or two for those at hand) and sent to every task.
    """
    known = counts.toPandas().sort_values("pair")
    schema = ", ".join(f"{c} {t}" for c, t in aligned.dtypes if c not in ("pairs", "times"))
    return aligned.mapInArrow(
        _scores(known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64)), f"{schema}, n_best bigint, count_sum bigint")


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    aligned = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256").write.parquet(folder)
    aligned = spark.read.parquet(folder)
    return score_links(aligned, pair_counts(aligned)).select(
        user_id("_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
