"""Normalising and cleaning of source texts and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.constants import (
    ANNOTATIONS, CJK, ERASE_ONLY, FAILURE_MARKER, HANGUL, KO_FIXES, PROMPT_HINTS, SFX_PREFIX, WS,
)
from pageloom.functions.base import ColumnLike, any_of, col, first_match, let, strip
from pageloom.functions.script import english_ratio, has_cjk, has_hangul

# start of a word: no letter, digit or underscore before it
_WORD_START = r"(?<![\p{L}\p{N}_])"


def normalize_text(text: ColumnLike, lang: ColumnLike | None = None) -> Column:
    """Collapse white space; Korean rows also get the recognition fix-ups."""
    t = strip(F.regexp_replace(F.coalesce(col(text), F.lit("")), f"{WS}+", " "))
    if lang is None:
        return t
    fixed = t
    for wrong, right in KO_FIXES:
        fixed = F.replace(fixed, F.lit(wrong), F.lit(right))
    return F.when(F.lower(col(lang)).isin("korean", "ko"), fixed).otherwise(t)


def watermark_lower(text: ColumnLike) -> Column:
    return F.lower(F.coalesce(col(text), F.lit("")))


def watermark_compact(text: ColumnLike) -> Column:
    """Lower case with separators removed."""
    return F.regexp_replace(watermark_lower(text), f"({WS}|[.\\-_:·•])+", "")


def watermark_key(text: ColumnLike) -> Column:
    return let(watermark_compact(text), lambda c: F.when(c != "", c).otherwise(watermark_lower(text)))


def clean_annotations(text: ColumnLike) -> Column:
    """Remove echoed prompt labels, translator notes and explanations."""
    out = col(text)
    for pattern in ANNOTATIONS:
        out = F.regexp_replace(out, pattern.replace(r"\b", _WORD_START), "")
    # most replies hold none of the words the steps look for
    suspect = col(text).rlike("(?i)TEXT|CTX|翻译|Note|注|This|context|direct")
    return strip(F.when(suspect, out).otherwise(col(text)))


def clean_input(text: ColumnLike, limit: int | None = None) -> Column:
    """Drop control characters; with a limit, also cut to so many characters."""
    control = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
    out = F.regexp_replace(F.coalesce(col(text), F.lit("")), control, "")
    return out if limit is None else F.substring(out, 1, limit)


def is_prompt_artifact(text: ColumnLike) -> Column:
    """A reply that leaks prompt wording."""
    def rules(out: Column) -> Column:
        lower = F.lower(out)
        hits = sum((lower.contains(h).cast("int") for h in PROMPT_HINTS), F.lit(0))
        english = english_ratio(out)
        talk = lower.contains("assistant") | lower.contains("translate") | lower.contains("output only")
        forbid = out.contains("不要") & (lower.contains("output") | lower.contains("translate"))
        long_text = (F.length(out) >= 24) & ~out.startswith(FAILURE_MARKER)
        return long_text & (hits > 0) & any_of([
            talk & (english >= 0.15), forbid, (hits >= 2) & (english >= 0.2),
        ])

    t = F.coalesce(col(text), F.lit(""))
    # short texts are settled without any pattern
    return F.when(F.length(t) >= 24, let(strip(t), rules)).otherwise(F.lit(False))


def skip_retranslate(source: ColumnLike, output: ColumnLike) -> Column:
    """Short or technical sources that are not worth a second request."""
    def rules(src: Column) -> Column:
        out = strip(F.coalesce(col(output), F.lit("")))
        return (src != "") & ~out.startswith(FAILURE_MARKER) & any_of([
            src.rlike(r"(?i)(https?://|www\.|discord\.gg/)"),
            src.rlike(r"(?i)^[\x{2160}-\x{2188}IVXLCDM]+\z"),
            src.rlike(r"^[A-Za-z][A-Za-z0-9._-]{0,5}\z"),
            src.rlike(r"^[A-Za-z0-9]{1,4}\z"),
            ~src.contains(" ") & (F.length(src) <= 12) & (out == src),
        ])

    return let(strip(F.coalesce(col(source), F.lit(""))), rules)


def needs_fallback(target: ColumnLike) -> Column:
    """A Chinese reply that is not Chinese enough."""
    return ~has_cjk(target) | has_hangul(target) | (english_ratio(F.coalesce(col(target), F.lit(""))) >= 0.35)


def text_kind(target: ColumnLike) -> Column:
    """empty, erase, failure, sfx or text."""
    t = F.coalesce(col(target), F.lit(""))
    return F.coalesce(
        first_match([
            (t == "", "empty"),
            (t == ERASE_ONLY, "erase"),
            (strip(t).startswith(FAILURE_MARKER), "failure"),
            (t.startswith(SFX_PREFIX), "sfx"),
        ]),
        F.lit("text"),
    )


def should_erase(target: ColumnLike, inpaint_mode: ColumnLike) -> Column:
    """Erase mode, or a real reply; never failures and sound-effect marks."""
    t = F.coalesce(col(target), F.lit(""))
    sfx = t.startswith(SFX_PREFIX) & t.endswith("]")
    real = (t != "") & ~strip(t).startswith(FAILURE_MARKER) & ~sfx
    return F.coalesce(col(inpaint_mode) == "erase", F.lit(False)) | real


def validate_output(source: ColumnLike, output: ColumnLike, target_lang: str = "zh") -> Column:
    """The cleaned reply, or the failure marker when it is not usable."""
    src = F.coalesce(col(source), F.lit(""))
    hangul = f"[{HANGUL}]"

    def check(cleaned: Column) -> Column:
        bad = [cleaned == ""]
        if target_lang.lower().startswith("zh"):
            bad += [
                cleaned.rlike(hangul),
                src.rlike(hangul) & ~cleaned.rlike(f"[{CJK}]"),
            ]
        bad.append(cleaned.rlike(hangul) & (cleaned == strip(src)))
        return F.when(any_of(bad), F.lit(FAILURE_MARKER)).otherwise(cleaned)

    return let(clean_annotations(F.coalesce(col(output), F.lit(""))), check)
