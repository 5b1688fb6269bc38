"""Which scripts a text uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.constants import (
    CJK, FAILURE_MARKER, HANGUL, HANGUL_WIDE, KANA, LATIN_LETTERS,
)
from pageloom.functions.base import ColumnLike, col, is_ascii, let, nonspace, strip


def is_failure(text: ColumnLike) -> Column:
    return F.coalesce(strip(text).startswith(FAILURE_MARKER), F.lit(False))


def has_cjk(text: ColumnLike) -> Column:
    """Has a unified ideograph; a failed reply never counts."""
    found = F.coalesce(col(text).rlike(f"[{CJK}]"), F.lit(False))
    return found & ~is_failure(text)


def has_hangul(text: ColumnLike) -> Column:
    return F.coalesce(col(text).rlike(f"[{HANGUL_WIDE}]"), F.lit(False))


def _share(text: ColumnLike, chars: str) -> Column:
    def ratio(body: Column) -> Column:
        kept = F.length(F.regexp_replace(body, f"[^{chars}]+", ""))
        return F.when(F.length(body) > 0, kept / F.length(body)).otherwise(F.lit(0.0))

    return let(nonspace(text), ratio)


def hangul_ratio(text: ColumnLike) -> Column:
    """Share of Hangul among the characters that are not white space."""
    return _share(text, HANGUL_WIDE)


def english_ratio(text: ColumnLike) -> Column:
    return _share(text, LATIN_LETTERS)


def script_bucket(text: ColumnLike) -> Column:
    """hangul, latin, cjk, mixed, or null without any of them."""
    t = col(text)
    hangul, latin, cjk = t.rlike(f"[{HANGUL}]"), t.rlike("[A-Za-z]"), t.rlike(f"[{CJK}]")
    seen = hangul.cast("int") + latin.cast("int") + cjk.cast("int")
    return (
        F.when(seen > 1, "mixed").when(hangul, "hangul").when(latin, "latin").when(cjk, "cjk")
    )


def script_type(text: ColumnLike) -> Column:
    t = col(text)
    return (
        F.when(t.rlike(f"[{HANGUL}]"), "ko")
        .when(t.rlike(f"[{KANA}]"), "jp")
        .when(t.rlike(f"[{CJK}]"), "cn")
        .when(is_ascii(t), "ascii")
        .when(t.isNotNull(), "other")
    )


def scripts_compatible(a: Column, b: Column) -> Column:
    """Two script buckets may be grouped: equal, mixed, or unknown."""
    clash = (a != b) & (a != "mixed") & (b != "mixed")
    return ~F.coalesce(clash, F.lit(False))
