"""Noise rules for recognised text, as one expression per rule set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom import constants as K
from pageloom.functions.base import (
    ColumnLike, any_of, col, first_match, is_ascii, let, nonspace, strip, strip_trailing_punct,
    with_base,
)
from pageloom.functions.sfx import is_sfx

SYMBOLS = r"[\\$^_{}]"
ALNUM_SHORT = r"^[A-Za-z]{1,2}[0-9]{2,4}\z"
SPACED_DIGITS = f"^\\p{{Nd}}+({K.WS}+\\p{{Nd}}+)+\\z"
ROMAN_ONLY = f"^[{K.ROMAN}]+\\z"
DIGITS_OR_SYMBOLS = r"^[^\p{L}\p{Nl}\p{No}_]+\z"


def _spaced_digits(base: Column) -> Column:
    return base.rlike(SPACED_DIGITS) & (F.length(nonspace(base)) <= 4)


def noise_reason(
    text: ColumnLike, width: ColumnLike, height: ColumnLike, y1: ColumnLike,
    confidence: ColumnLike, image_height: ColumnLike | int = 0, relaxed: bool = False,
) -> Column:
    """Why a detected region is noise; null keeps it.

    ``relaxed`` keeps only the rules that are safe before merging.
    """
    t, w, h, top = col(text), col(width), col(height), col(y1)
    tall = F.lit(image_height) if isinstance(image_height, int) else col(image_height)
    return let(
        strip_trailing_punct(t), lambda base: _reason(base, t, w, h, top, col(confidence), tall, relaxed)
    )


def _reason(base, t, w, h, top, confidence, tall, relaxed: bool) -> Column:
    aspect = w / F.greatest(h, F.lit(1))
    price = base.rlike(r"^[0-9,.]+\z") & any_of([
        F.length(base) >= 4,
        base.contains(","),
        (tall > 0) & (top > tall * F.lit(0.8)),
        w > h * 3,
    ])
    always = [
        (base.rlike(r"^[0OoSs]+\z"), "zeros"),
    ]
    last = [r"^[-\x{2212}\x{2013}\x{2014}]+\z", r"^[I1l|]+\z", f"^({K.WS}|\\.)+\\z"]
    rules: list[tuple[Column, str]] = [
        (w.isNull() | t.isNull() | (t == ""), "missing"),
        (base == "", "empty"),
    ]
    if not relaxed:
        rules += [
            ((w < 15) | (h < 10), "size"),
            ((aspect > 20) | (aspect < 0.05), "aspect"),
            ((F.length(t) <= 3) & (confidence < 0.85) & is_ascii(t), "short_ascii"),
            (price, "price"),
        ]
    rules += always
    if not relaxed:
        rules += [
            (base.rlike(r"(?i)\.(com|net|org|io|cn)\z"), "domain"),
            (base.rlike(r"^[A-Z]+(SCANS?|COMICS?)\z"), "credit"),
            (
                is_ascii(base) & (F.length(base) > 15) & ~base.contains(" ")
                & ~base.rlike("[a-z]"),
                "caps_run",
            ),
            (base.rlike(SYMBOLS), "symbol"),
            (base.rlike(ALNUM_SHORT), "alnum_short"),
            (_spaced_digits(base), "spaced_digits"),
            (base.rlike(f"^[A-Z]{{3,4}}{K.WS}[A-Z][a-z]-[A-Z][a-z],?\\z"), "weird_split"),
            (base.rlike(ROMAN_ONLY), "roman"),
        ]
        last += [
            r"^[A-Za-z]\z", r"^[A-Za-z][0-9]\.\z", r"^[A-Z]{2}\z", r"^[a-z][0-9]\z",
            r"^0+[A-Za-z]+\z", r"^[A-Za-z]+0+\z",
        ]
    rules.append((any_of([base.rlike(p) for p in last]), "pattern"))
    return first_match(rules)


def is_noise(*args, **kwargs) -> Column:
    return noise_reason(*args, **kwargs).isNotNull()


def ocr_noise_reason(text: ColumnLike) -> Column:
    """The variant used before scoring; sound effects are exempt."""
    def rules(v: Column) -> Column:
        raw, base = v["raw"], v["base"]
        ruled = first_match([
            (base.rlike(SYMBOLS), K.REASON_SYMBOL),
            (base.rlike(r"^[A-Z]{2}\z"), K.REASON_CAPS),
            (base.rlike(ALNUM_SHORT), K.REASON_ALNUM),
            (base.rlike(r"^\p{Nd}+\z") & (F.length(base) <= 3), K.REASON_SHORT_DIGITS),
            (_spaced_digits(base), K.REASON_SPACED_DIGITS),
            (base.rlike(ROMAN_ONLY), K.REASON_ROMAN),
        ])
        # the rules are cheaper than the sound-effect test, which only lifts them
        return F.when(raw == "", K.REASON_EMPTY).when(
            (base != "") & ruled.isNotNull() & ~is_sfx(raw), ruled
        )

    return let(with_base(F.coalesce(col(text), F.lit(""))), rules)


def merge_noise(text: ColumnLike) -> Column:
    """Rows that must stay out of line merging."""
    return let(strip_trailing_punct(F.coalesce(col(text), F.lit(""))), lambda base: (base != "") & any_of([
        base.rlike(SYMBOLS),
        base.rlike(r"^[A-Z]{2}\z"),
        base.rlike(ALNUM_SHORT),
        base.rlike(r"^\p{Nd}+\z") & (F.length(base) <= 3),
        _spaced_digits(base),
        base.rlike(ROMAN_ONLY),
    ]))


def skip_translation_reason(text: ColumnLike) -> Column:
    return let(strip(F.coalesce(col(text), F.lit(""))), lambda t: first_match([
        (t == "", K.REASON_EMPTY),
        (t.rlike(DIGITS_OR_SYMBOLS), K.REASON_DIGITS),
        (t.rlike(ROMAN_ONLY), K.REASON_ROMAN),
    ]))


def detection_reject(
    text: ColumnLike, score: ColumnLike, min_score: float = 0.5, lang: ColumnLike | str = "en",
    min_len: int | None = None,
) -> Column:
    """Why a raw detection is dropped; null keeps it.

    Without ``min_len`` the language column decides: 1 for Korean, else 2.
    """
    clean = strip(col(text))
    if min_len is None:
        korean = F.lower(col(lang)).isin("korean", "ko", "kr")
        least = F.when(korean, 1).otherwise(2)
    else:
        least = F.lit(min_len)
    return first_match([
        (clean.isNull() | (clean == ""), "empty"),
        (col(score).isNull(), "no_score"),
        (col(score) < min_score, "low_score"),
        (F.length(clean) < least, "too_short"),
        (clean.rlike(r"^[.,;:\-'\"!?()\[\]{}|/\\]+\z"), "punctuation"),
    ])
