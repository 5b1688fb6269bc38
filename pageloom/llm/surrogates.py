"""Keyed surrogates for personal data.

1. Detect: one pass over the whole texts finds entities (patterns below) and gives
   each a normal form, so that one number written in two ways is one entity.
2. Draw: every distinct (kind, normal form) gets a replacement from a keyed hash:
   digits for digits, letters for letters of the same case, cards keep their check
   digit, addresses stay addresses, names keep script and gender.
3. Check collisions over all entities at once: a replacement may be neither another
   entity's replacement nor any real entity; losers draw again until none is left.
   After some draws a replacement grows, so no kind can run out.
4. Replace: each document receives the replacements of its own entities and pours
   them into the format found, so equal entities are equal afterwards, everywhere.
   Words of a name are also replaced where they follow later without a title.

What is drawn depends on the key and the entity alone, except where a collision
forced another draw.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import row_id, table, user_id
from pageloom.skew import checkpoint

KEY = "surrogates"
#: draws of one entity before its replacement grows with every further draw
GROW_AFTER = 8

# -- fixed values: titles that tell a name follows, with the gender they tell
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "x", "Prof": "x", "Herr": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
#: syllables of invented names by script, and endings by gender
SYLLABLES = {
    "LATIN": "ba be bi bo da de di do fa fe ga ge ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti va ve".split(),
    "CYRILLIC": "ба бе би бо да де ди до га ка ки ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се та те ти ва ве".split(),
    "GREEK": "βα βε βι βο δα δε δι δο γα κα κι λα λε λι λο μα με μι μο να νε νι νο πα ρα ρε ρι ρο σα σε τα τε τι".split(),
}
ENDINGS = {
    "LATIN": {"m": "n", "f": "na", "x": "l"}, "CYRILLIC": {"m": "н", "f": "на", "x": "л"},
    "GREEK": {"m": "ς", "f": "να", "x": "ν"},
}

_NAME = r"[^\W\d_a-zà-öø-ÿ][^\W\d_]+"
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+"),
    ("secret", r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9-]{16,}"
               r"|(?<=password=)\S+|(?<=passwd=)\S+|(?<=secret=)\S+|(?<=token=)\S+|(?<=api_key=)\S+"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}(?!\d)"
              r"|\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\d-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])"),
    ("name", rf"\b(?:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME}){{0,2}}"),
)
BARE = re.compile(rf"\b{_NAME}\b")
DETECT = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS))
#: no entity spans lines, and every one has one of these in its line
GATE = re.compile(rf"[\d@=]|gh[pousr]_|sk-|(?:{'|'.join(TITLES)})\.? ")


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN").split(" ")[0]
    return name if name in SYLLABLES else "LATIN"


def _name_words(found: str) -> tuple[str, str, list[str]]:
    """(title as written, gender, words)."""
    title, *words = found.split(" ")
    return title, TITLES[title.rstrip(".")], words


def normal_forms(kind: str, found: str) -> list[tuple[str, str]]:
    """(kind, normal form) of what must be the same wherever it is written."""
    if kind == "name":
        _, gender, words = _name_words(found)
        # the first of several words is a given name and has a gender
        kinds = [f"name-{gender}" if len(words) > 1 and i == 0 else "name-x" for i in range(len(words))]
        return [(k, w.casefold()) for k, w in zip(kinds, words)]
    if kind in ("card", "ssn", "iban"):
        return [(kind, re.sub(r"[ -]", "", found))]
    if kind == "phone":
        return [(kind, re.sub(r"[^\d+]", "", found))]
    return [(kind, found.lower() if kind == "email" else found)]


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: str, *what: object):
        self.seed = hashlib.blake2b("\0".join(map(str, what)).encode(), key=key.encode()[:64], digest_size=32).digest()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.blake2b(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        number, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return number % n


def _digit(number: int, like: str) -> str:
    """A decimal digit in the script of another; any decimal digit has its zero that far below it."""
    return chr(ord(like) - unicodedata.decimal(like) + number)


def _like(text: str, draw: _Stream) -> str:
    """Digits for digits of the same script, letters for letters of the same case, ASCII marks as they are.

    Other characters beyond ASCII give letters too; where nothing but marks was found, all do.
    """
    if text.isascii() and not any(c.isalnum() for c in text):
        return "".join(chr(97 + draw.below(26)) for _ in text)
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append(str(draw.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + draw.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + draw.below(26)))
        elif c.isdecimal():
            out.append(_digit(draw.below(10), c))
        elif not c.isascii():
            out.append(chr((65 if c.isupper() else 97) + draw.below(26)))
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def surrogate(key: str, kind: str, value: str, attempt: int) -> str:
    """The replacement of a normal form, by key and number of the draw."""
    draw = _Stream(key, kind, value, attempt)
    grown = max(0, attempt - GROW_AFTER + 1)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        hosts = _Stream(key, "domain", domain)
        return f"{_like(local + 'x' * grown, draw)}@{'.'.join([*(_like(x, hosts) for x in labels[:-1]), labels[-1]])}"
    if kind == "ip":
        first = value.split(".")[0]
        kept = first if first in ("10", "127", "192", "172") else str(1 + draw.below(223))
        parts = [kept, *(str(draw.below(256)) for _ in range(2)), str(1 + draw.below(254))]
        return ".".join([*parts, *(str(draw.below(256)) for _ in range(grown))])
    if kind == "card":
        body = value[0] + _like(value[1:-1] + value[-1] * grown, draw)
        # the same remainder of the check sum, so valid stays valid
        last = next(d for d in (_digit(n, value[-1]) for n in range(10)) if luhn(body + d) == luhn(value))
        return body + last
    if kind == "phone" and value.startswith("+"):
        return value[:2] + _digit(1 + draw.below(9), value[2]) + _like(value[3:] + value[-1] * grown, draw)
    if kind in ("phone", "ssn"):
        return _like(value + value[-1] * grown, draw)
    if kind == "iban":
        return value[:2] + _like(value[2:] + "0" * grown, draw)
    if kind == "secret":
        kept = "AKIA" if value.startswith("AKIA") else ""
        return kept + _like(value[len(kept):], draw) + _like("x" * grown, draw)
    if kind.startswith("name-"):
        script = script_of(value)
        length = 2 + attempt // 4 + draw.below(2)
        return "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(length)) + ENDINGS[script][kind[-1]]
    return _like(value, draw)


def pour(found: str, normal: str) -> str:
    """Characters of a replacement in the format that was found; a longer one goes on behind it."""
    marks = iter(normal.replace("+", ""))
    return "".join(next(marks) if c.isalnum() else c for c in found) + "".join(marks)


def _case(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize()


def replace(text: str, known: dict[tuple[str, str], str]) -> tuple[str, int]:
    """The text with replacements, and how many entities it had.

    The words of a name are replaced wherever they stand alone later on, written the same way.
    """
    count = 0
    names: dict[str, str] = {}

    def one(m: re.Match) -> str:
        nonlocal count
        count += 1
        kind, found = m.lastgroup, m[0]
        forms = normal_forms(kind, found)
        if kind == "name":
            title, _, words = _name_words(found)
            new = [_case(known[f], w) for f, w in zip(forms, words)]
            names.update({w: n for w, n in zip(words, new) if w not in names})
            return " ".join([title, *new])
        new = known[forms[0]]
        return pour(found, new) if kind in ("card", "ssn", "iban", "phone") else new

    def between(line: str, a: int, b: int) -> str:
        nonlocal count
        if not names or a == b:
            return line[a:b]
        out = []
        for m in BARE.finditer(line, a, b):
            if m[0] not in names:
                continue
            out += [line[a:m.start()], names[m[0]]]
            a = m.end()
            count += 1
        return "".join([*out, line[a:b]])

    if not GATE.search(text):
        return text, 0
    lines = []
    for line in text.split("\n"):
        out, at = [], 0
        for m in DETECT.finditer(line) if GATE.search(line) else ():
            out += [between(line, at, m.start()), one(m)]
            at = m.end()
        lines.append("".join([*out, between(line, at, len(line))]))
    return "\n".join(lines), count


def entities_of(text: str) -> set[tuple[str, str]]:
    if not GATE.search(text):
        return set()
    return {
        f for line in text.split("\n") if GATE.search(line)
        for m in DETECT.finditer(line) for f in normal_forms(m.lastgroup, m[0])
    }


_ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            found.append([{"kind": k, "value": v} for k, v in sorted(entities_of(text))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_tag"), pa.array(found, _ENTITIES)], names=["_id", "_tag", "entities"])


def _draw(key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([surrogate(key, *r) for r in rows], pa.string())], names=[*batch.schema.names, "surrogate"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, known in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist()):
            if known:
                text, n = replace(text, {(k["kind"], k["value"]): k["surrogate"] for k in known})
            else:
                n = 0
            texts.append(text)
            counts.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["_id", "text", "n_entities"])


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, value, surrogate of distinct (kind, value), without collisions."""
    real = entities.select("kind", F.col("value").alias("surrogate"))
    left = entities.withColumn("attempt", F.lit(0))
    settled: DataFrame | None = None
    while True:
        drawn = left.mapInArrow(_draw(key), "kind string, value string, attempt int, surrogate string")
        taken = real if settled is None else real.unionByName(settled.select("kind", "surrogate"))
        free = drawn.join(taken.withColumn("taken", F.lit(True)).distinct(), ["kind", "surrogate"], "left")
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("value")) == 1
        judged = checkpoint(free.withColumn("good", F.col("taken").isNull() & first))
        good = judged.where("good").select("kind", "value", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        left = judged.where("not good").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if left.isEmpty():
            return settled


def pseudonymize(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text and n_entities, a row per input row.

    A null text counts as empty.  Rows are answered one by one, also where a doc_id is
    null or repeats.  Texts without entities come back as they are; other columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(row_id().alias("_id"), F.xxhash64(text).alias("_tag"), text.alias("text"))
    found = checkpoint(texts.mapInArrow(
        _detect, "_id long, _tag long, entities array<struct<kind: string, value: string>>").where(F.size("entities") > 0))
    each = found.select("_id", "_tag", F.explode("entities").alias("e")).select("_id", "_tag", "e.kind", "e.value")
    named = assign(checkpoint(each.select("kind", "value").distinct()), key)
    known = each.join(named, ["kind", "value"]).groupBy("_id", "_tag").agg(
        F.collect_set(F.struct("kind", "value", "surrogate")).alias("known"))
    done = texts.join(known, ["_id", "_tag"], "left").select("_id", "text", "known").mapInArrow(
        _apply, "_id long, text string, n_entities long")
    return done.select(user_id("_id").alias("doc_id"), "text", "n_entities")


def op9_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"))
