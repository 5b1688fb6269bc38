"""Sound-effect detection and dictionary lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.constants import (
    HANGUL, KANA, SFX_CAPS_WORDS, SFX_CN_WORDS, SFX_EN, SFX_EXCLUSIONS, SFX_KO, SFX_KO_WORDS,
)
from pageloom.functions.base import (
    ColumnLike, any_of, before_trailing_punct, col, let, literal_map, strip, trailing_punct,
    with_base,
)

# A one- or two-syllable unit said at least twice.
REPEATED_HANGUL = f"^([{HANGUL}]{{1,2}})\\1+\\z"


def is_sfx(text: ColumnLike) -> Column:
    """Sound effect by dictionary, caps, laughter, kana or repetition."""
    caps = "|".join(SFX_CAPS_WORDS)
    cn = "|".join(sorted(SFX_CN_WORDS, key=len, reverse=True))

    def rules(v: Column) -> Column:
        raw, base, upper_raw = v["raw"], v["base"], F.upper(v["raw"])
        effect = any_of([
            base.isin(*SFX_KO, *SFX_KO_WORDS, *SFX_CN_WORDS),
            F.upper(base).isin(*SFX_EN),
            upper_raw.rlike(
                f"^(?:\\*+[^\\n]*\\*+\\n?|(?:{caps})!*|(?:(?:HA)+|(?:HE)+|(?:HO)+|(?:HM)+)!*|[A-Z]{{2,4}}!+)\\z"
            ),
            raw.rlike(f"^(?:(?:{cn})+[！!]*|[{KANA}]{{2,8}}[!！]?)\\z"),
            base.rlike(REPEATED_HANGUL),
        ])
        return (
            F.when(raw.rlike(r"^[!！?？]+\z"), F.lit(True))
            .when(base == "", F.lit(False))
            .when(F.upper(base).isin(*SFX_EXCLUSIONS), F.lit(False))
            .otherwise(effect)
        )

    return let(with_base(F.coalesce(col(text), F.lit(""))), rules)


def translate_sfx(text: ColumnLike) -> Column:
    """Dictionary word plus the closing punctuation; unknown words stay."""
    def lookup(v: Column) -> Column:
        raw, key = v["raw"], v["key"]
        word = F.coalesce(
            F.try_element_at(literal_map(SFX_EN), F.upper(key)), F.try_element_at(literal_map(SFX_KO), key), key,
        )
        return F.when(key == "", raw).otherwise(F.concat(word, trailing_punct(raw)))

    raw = strip(F.coalesce(col(text), F.lit("")))
    keyed = let(raw, lambda r: F.struct(r.alias("raw"), strip(before_trailing_punct(r)).alias("key")))
    return let(keyed, lookup)
