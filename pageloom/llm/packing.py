"""Packing of documents into windows by lexical retrieval.

Documents are tokenized once, where they lie; words repeat, so a bounded cache of
words saves most of the work.  A document longer than a window gives whole windows;
what is left of it, at most one window, is packed with others.  From here on only
spans travel: where a piece starts, its length, the checksum of its ids, and its
distinct ids with their counts.

Retrieval is BM25 over token ids.  Document frequencies and the mean length are
counted over all pieces; a vocabulary is bounded, so they are broadcast.  The index
is sharded: pieces are range-partitioned by their heaviest terms, with their ids as
tie-break so that a large group of alike pieces is cut anywhere, and every
``SHARD`` pieces have an inverted index of their own: for each term its pieces, the
shorter first, with their weights.  In a shard the longest unused piece is a seed; the
lists of all its terms are read, as far as pieces fit, and all unused pieces found fill
the window in the order of their scores.  Used pieces leave the lists from time to time.  What room is left then goes
to the largest pieces that fit.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import LOWER, NOT_SPACE, WordHash, byte_set, chunks, find_words, row_id, table, user_id
from pageloom.skew import checkpoint

WINDOW, END_ID = 2048, 1
VOCABULARY = "word_bpe_49k.json"
#: marks that are tokens of their own after a letter or digit; not those that end a special token; at most so many are parted
IS_MARK, MARKS = byte_set(b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"), 8
IS_PLAIN = byte_set([*range(0x30, 0x3A), *range(0x61, 0x7B)])
#: second bytes of the letters from U+00C0 to U+00FF
LATIN, IS_LATIN = 0xC3, byte_set(set(range(0x80, 0xC0)) - {0x97, 0xB7})
#: words that a worker remembers (some 35 bytes each, whatever their length); their hashes have 64 bits
CACHE, SEED = 1_000_000, 42
#: texts by which the shortcut over words is tested when a tokenizer is loaded
PROBES = ["Two  Words,\n\tthree; it's 12.5% (of) x_y!?", "ÉCOLE Straße e\u0301 漢字, 😀. \u00a0x", " \u200b end", "", "a.b ,c ..."]
#: bytes of text tokenized together
PART = 4 << 20
#: pieces searched together
SHARD = 4_096
K1, B = 1.2, 0.75
#: a term and its count in one number
COUNTS = 4096


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Ids:
    """Ids of texts (unsigned, little-endian, 32 bits), by way of their words.

    White space never survives this tokenizer, so the ids of a text are those of
    its words, one after another.  It lowers its input and parts letters from
    punctuation marks after them, so ``Word,`` is looked up as ``word`` and ``,``.
    Another kind of tokenizer is told by ``PROBES`` and reads whole texts.

    Words met before are remembered as arrays: their hashes in order, and where the
    ids of each lie.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.hash = Tokenizer.from_file(path), WordHash(SEED)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()
        self.whole = False
        want = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tolist() for t in PROBES]
        ids, at = self.of(pa.array(PROBES))
        self.whole = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] != want
        self._forget()

    def _forget(self) -> None:
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.held = np.zeros(1 << 16, "<u4"), 0

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """Words of lower-case ASCII letters: nothing to normalize or to part, the model sees them as they are."""
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(w.decode())]).tobytes() for w in words]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Words of letters, each with one token that ends a word, in one call."""
        (all_ids,) = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(all_ids.ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words):
            return self._one_by_one(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        plain, letters, others = [], [], []
        for i, word in enumerate(words):
            if word.isalpha():
                plain.append(i)
            else:
                text = word.decode()
                (letters if text.isalpha() and text.lower().isalpha() else others).append(i)
        out = [b""] * len(words)
        for group, encode, size in ((plain, self._plain, 4096), (letters, self._together, 128), (others, self._one_by_one, 4096)):
            for lo in range(0, len(group), size):
                some = group[lo:lo + size]
                for i, ids in zip(some, encode([words[i] for i in some])):
                    out[i] = ids
        return out

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Remember new words, by their hashes in order."""
        found = self._encoded(words)
        size = np.array([len(f) // 4 for f in found], np.int32)
        start = self.held + np.concatenate(([0], np.cumsum(size[:-1], dtype=np.int64)))
        more = np.frombuffer(b"".join(found), "<u4")
        if self.held + len(more) > len(self.ids):
            self.ids = np.concatenate((self.ids[:self.held], np.zeros(self.held // 2 + len(more), "<u4")))
        self.ids[self.held:self.held + len(more)] = more
        self.held += len(more)
        at = np.searchsorted(self.known, hashes)
        self.known, self.start, self.size = (
            np.insert(old, at, new) for old, new in ((self.known, hashes), (self.start, start), (self.size, size)))

    def _missing(self, found: np.ndarray) -> np.ndarray:
        """Which hashes, in order, are of words not met before."""
        if not len(self.known):
            return np.arange(len(found))
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        return np.flatnonzero(self.known[at] != found)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text (null: none) begin and end.

        Each different word is looked up once a call; its ids are then copied to their places.
        """
        if self.whole:
            found = self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            sizes = [len(e.ids) for e in found]
            return np.fromiter(chain.from_iterable(e.ids for e in found), "<u4", sum(sizes)), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        data, ends, first = _words(texts)
        if not len(ends):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        found, at = np.unique(self.hash(data, starts, ends), return_inverse=True)
        new = self._missing(found)
        if len(self.known) + len(new) > CACHE:
            self._forget()
            new = self._missing(found)
        if len(new):
            place = np.empty(len(found), np.int64)
            place[at] = np.arange(len(at))
            place, raw = place[new], data.tobytes()
            self._learn(found[new], [raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist())])
        which = np.searchsorted(self.known, found)
        sizes = self.size[which][at]
        end = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        copied = self.ids[np.repeat(self.start[which][at] - end[:-1], sizes) + np.arange(end[-1])]
        return copied, end[first]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts one after another, lower-cased (A-Z), where each ends, and the first word of each text.

    Up to ``MARKS`` punctuation marks at the end of a word, after a letter or digit, are a word of their own.
    """
    (_, _, buf, offs), = chunks(texts, max(1, texts.nbytes))
    buf = LOWER[buf]
    starts, ends, first = find_words(buf, offs, NOT_SPACE)
    size, marks = ends - starts, np.zeros(len(ends), np.int64)
    open_ = np.flatnonzero(IS_MARK[buf[ends - 1]]) if len(ends) else np.zeros(0, np.int64)
    for n in range(1, MARKS + 1):
        # those with n marks at least, and something before them
        open_ = open_[size[open_] > n]
        last = ends[open_] - n - 1
        before = buf[last]
        letter = IS_PLAIN[before] | (IS_LATIN[before] & (size[open_] > n + 1) & (buf[last - 1] == LATIN))
        marks[open_[letter]] = n
        open_ = open_[IS_MARK[before]]
    parted = marks > 0
    # two words in place of one: the second is the marks
    sizes = np.repeat(size - marks, 1 + parted)
    sizes[np.cumsum(1 + parted)[parted] - 1] = marks[parted]
    before = np.concatenate(([0], np.cumsum(1 + parted)))
    return buf[NOT_SPACE[buf]], np.cumsum(sizes), before[first]


@cache
def _ids(path: str) -> Ids:
    """One per Python worker, so that tasks share what was learned."""
    return Ids(path)


PIECE = "_id long, start long, length long, ids_crc32 long, doc_tokens long, terms array<int>"


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``PART`` bytes of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    total, lo = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PART, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _cut(keys: pa.Array, ids: np.ndarray, at: np.ndarray, window: int) -> pa.RecordBatch:
    """Pieces of documents; the ids of each begin and end in ``at``, and the end id follows."""
    docs = len(keys)
    at = at + np.arange(docs + 1)
    flat = np.empty(at[-1], "<u4")
    flat[at[1:] - 1] = END_ID
    own = np.ones(len(flat), bool)
    own[at[1:] - 1] = False
    flat[own] = ids
    total = np.diff(at)
    pieces = -(-total // window)
    doc = np.repeat(np.arange(docs), pieces)
    start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    length = np.minimum(window, total[doc] - start)
    begin = at[doc] + start
    sums = [zlib.crc32(flat[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
    # pieces lie one after another, so equal ids of a piece stand together in this order
    kinds = int(flat.max()) + 1
    placed = np.sort(np.repeat(np.arange(len(doc)), length) * kinds + flat)
    first = np.flatnonzero(np.concatenate(([True], placed[1:] != placed[:-1])))
    count = np.diff(np.append(first, len(placed)))
    piece, term = np.divmod(placed[first], kinds)
    terms = (term * COUNTS + np.minimum(count, COUNTS - 1)).astype(np.int32)
    ends = np.concatenate(([0], np.cumsum(np.bincount(piece, minlength=len(doc))))).astype(np.int32)
    numbers = [pa.array(c, pa.int64()) for c in (start, length, sums, total[doc])]
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(doc)), *numbers, pa.ListArray.from_arrays(pa.array(ends), pa.array(terms))],
        names=["_id", "start", "length", "ids_crc32", "doc_tokens", "terms"])


def _pieces(path: str, window: int) -> Callable:
    """(_id, text) -> pieces of at most a window, with their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = _ids(path)
        for batch in batches:
            for part in _parts(batch):
                yield _cut(part.column("_id"), *ids.of(part.column("text")), window)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """terms -> (term, pieces with it), once a task."""
    n = np.zeros(0, np.int64)
    for batch in batches:
        more = np.bincount(batch.column("terms").flatten().to_numpy() // COUNTS, minlength=len(n))
        more[:len(n)] += n
        n = more
    term = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(n[term])], names=["term", "n"])


class Bm25:
    """Weights of terms from counts over all pieces."""

    def __init__(self, frequency: np.ndarray, pieces: int, mean: float):
        self.idf = np.log1p((pieces - frequency + 0.5) / (frequency + 0.5))
        self.mean = mean

    def weigh(self, packed: np.ndarray, length: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        terms, tf = packed // COUNTS, packed % COUNTS
        return terms, self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


def _signs(model: Bm25) -> Callable:
    """Adds the two heaviest terms of a piece, by which shards are ordered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.full((batch.num_rows, 2), -1, np.int32)
            size = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy()
            held = np.flatnonzero(size)
            if len(held):
                piece, begin = np.repeat(held, size[held]), np.cumsum(size[held]) - size[held]
                terms, weight = model.weigh(batch.column("terms").flatten().to_numpy(), batch.column("length").to_numpy()[piece])
                for sign in signs.T:
                    top = np.repeat(np.maximum.reduceat(weight, begin), size[held])
                    heaviest = np.flatnonzero((weight == top) & (weight > -np.inf))
                    # the first of equally heavy ones
                    heaviest = heaviest[np.unique(piece[heaviest], return_index=True)[1]]
                    sign[piece[heaviest]] = terms[heaviest]
                    weight[heaviest] = -np.inf
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(signs[:, 0]), pa.array(signs[:, 1])], names=[*batch.schema.names, "sign", "sign2"])

    return run


class Inverted:
    """Posting lists of the pieces of a shard: a term's pieces in order of their length, with their weights.

    Pieces are numbered by length, so those that fit in a window stand first in every list.
    """

    def __init__(self, weighed: list[tuple[np.ndarray, np.ndarray] | None], lengths: np.ndarray):
        held = [i for i, w in enumerate(weighed) if w is not None]
        self.piece = np.array(sorted(held, key=lambda i: (lengths[i], i)), np.int64)
        self.size = lengths[self.piece]
        none = np.zeros(0, np.int64)
        term = np.concatenate([none, *(weighed[i][0] for i in self.piece)])
        number = np.repeat(np.arange(len(self.piece)), [len(weighed[i][0]) for i in self.piece])
        order = np.argsort(term, kind="stable")
        self.term, self.number = term[order], number[order]
        self.weight = np.concatenate([none.astype(float), *(weighed[i][1] for i in self.piece)])[order]
        self.terms = int(self.term[-1]) + 1 if len(self.term) else 0
        self._places()

    def _places(self) -> None:
        # one number for a place in a list, and where the list of each term begins
        self.place = self.term * (len(self.piece) + 1) + self.number
        self.begin = np.searchsorted(self.term, np.arange(self.terms))

    def keep(self, free: np.ndarray) -> None:
        """Take out pieces that are no longer free, once they are many."""
        left = free[self.piece]
        if np.count_nonzero(left) >= 0.7 * len(left):
            return
        renumbered, some = np.cumsum(left) - 1, left[self.number]
        self.term, self.number, self.weight = self.term[some], renumbered[self.number[some]], self.weight[some]
        self.piece, self.size = self.piece[left], self.size[left]
        self._places()

    def neighbours(self, terms: np.ndarray, room: int, free: np.ndarray) -> np.ndarray:
        """Free pieces of at most ``room`` that share a term, in the order of their scores."""
        fit, step = int(np.searchsorted(self.size, room, "right")), len(self.piece) + 1
        if not fit:
            return self.piece[:0]
        lists = list(map(slice, self.begin[terms].tolist(), np.searchsorted(self.place, terms * step + fit).tolist()))
        number, weight = (np.concatenate([x[part] for part in lists]) for x in (self.number, self.weight))
        score = np.bincount(number, weight, fit)
        some = np.flatnonzero((score > 0) & free[self.piece[:fit]])
        return self.piece[some[np.lexsort((self.piece[some], -score[some]))]]


def pack_shard(lengths: list[int], packed: list[np.ndarray | None], model: Bm25, window: int) -> list[list[int]]:
    """Groups of piece numbers, each at most a window long."""
    n = len(lengths)
    size = np.array(lengths)
    weighed = [model.weigh(p, lengths[i]) if p is not None else None for i, p in enumerate(packed)]
    free = np.ones(n, bool)
    pool: list[list[int]] = [[] for _ in range(window + 1)]
    for i in range(n - 1, -1, -1):
        pool[lengths[i]].append(i)
    have = np.array([len(p) for p in pool])

    def take(i: int) -> None:
        free[i] = False
        have[lengths[i]] -= 1

    index = Inverted(weighed, size)
    groups = []
    for seed in sorted(range(n), key=lambda i: (-lengths[i], i)):
        if not free[seed]:
            continue
        take(seed)
        group, room = [seed], window - lengths[seed]
        if room and weighed[seed] is not None:
            index.keep(free)
            near = index.neighbours(weighed[seed][0], room, free)
            while room:
                fits = size[near] <= room
                if not fits.any():
                    break
                first = int(fits.argmax())
                i, near = int(near[first]), near[first + 1:]
                take(i)
                group.append(i)
                room -= lengths[i]
        while room:
            fits = np.flatnonzero(have[:room + 1])
            if not len(fits):
                break
            bucket = pool[fits[-1]]
            while not free[bucket[-1]]:
                bucket.pop()
            i = bucket.pop()
            take(i)
            group.append(i)
            room -= lengths[i]
        groups.append(group)
    return groups


OUT = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(model: Bm25, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, rows = TaskContext.get().partitionId() << 32, []
        names = ("_id", "start", "length", "ids_crc32", "doc_tokens")

        def flush() -> pa.RecordBatch:
            nonlocal made
            groups = pack_shard([r[2] for r in rows], [r[5] for r in rows], model, window)
            out = []
            for group in groups:
                offset = 0
                for i in group:
                    out.append((*rows[i][:5], made, offset))
                    offset += rows[i][2]
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[*names, "sequence_id", "offset"])

        for batch in batches:
            lists = [p.values.to_numpy() if p.is_valid else None for p in batch.column("terms")]
            for row in zip(*(batch.column(c).to_pylist() for c in names), lists):
                rows.append(row)
                if len(rows) == SHARD:
                    yield flush()
                    rows = []
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece.

    Every document is its ids and the end id; a null or empty text is the end id
    alone.  Rows with one doc_id are packed one by one.  ``path`` names the
    tokenizer's file.  Other columns are ignored.
    """
    pieces = checkpoint(docs.select(row_id().alias("_id"), "text").mapInArrow(_pieces(path or vocabulary_path(), window), PIECE))
    facts = pieces.agg(F.count(F.lit(1)).alias("all"), F.avg("length").alias("mean")).first()
    seen = pieces.select("terms").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(int(seen["term"].max()) + 1 if len(seen) else 1)
    frequency[seen["term"]] = seen["n"]
    model = Bm25(frequency, facts["all"], facts["mean"] or 1.0)
    shards = max(1, math.ceil(facts["all"] / SHARD))
    # a whole window is only counted
    signed = pieces.withColumn("terms", F.when(F.col("length") < window, F.col("terms"))).mapInArrow(_signs(model), f"{PIECE}, sign int, sign2 int")
    order = ["sign", "sign2", "_id", "start", "ids_crc32"]
    packed = signed.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(_pack(model, window), OUT)
    # sequence numbers are fixed once, whatever is repeated later
    return checkpoint(packed).select(
        user_id("_id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_lexical_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
