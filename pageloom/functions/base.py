"""Small helpers the other column functions share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.constants import NOT_WS, TRAIL_PUNCT, WS

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def first_match(rules: list[tuple[Column, str]]) -> Column:
    """Label of the first rule that holds, else null."""
    (cond, label), *rest = rules
    out = F.when(cond, F.lit(label))
    for cond, label in rest:
        out = out.when(cond, F.lit(label))
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not once per use in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(text: ColumnLike) -> Column:
    """Remove Unicode white space at both ends."""
    trimmed = F.regexp_replace(col(text), f"^{WS}+", "")
    return F.regexp_replace(trimmed, f"(?<={NOT_WS}){WS}+\\z", "")


def nonspace(text: ColumnLike) -> Column:
    return F.regexp_replace(col(text), f"{WS}+", "")


def strip_trailing_punct(text: ColumnLike) -> Column:
    """Drop closing punctuation, then white space."""
    return strip(F.regexp_replace(col(text), f"[{TRAIL_PUNCT}]+(\\n?)\\z", "$1"))


def with_base(text: ColumnLike) -> Column:
    """Struct (raw, base): stripped, and also without closing punctuation."""
    return let(strip(text), lambda raw: F.struct(raw.alias("raw"), strip_trailing_punct(raw).alias("base")))


def trailing_punct(text: ColumnLike) -> Column:
    """The closing punctuation itself ('' when there is none)."""
    return F.regexp_extract(col(text), f"([{TRAIL_PUNCT}]+)\\n?\\z", 1)


def before_trailing_punct(text: ColumnLike) -> Column:
    return F.regexp_replace(col(text), f"[{TRAIL_PUNCT}]+\\n?\\z", "")


def is_ascii(text: ColumnLike) -> Column:
    return col(text).rlike(r"^[\x{00}-\x{7F}]*\z")
