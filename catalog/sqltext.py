"""SQL fragments the text oracles share (written for DuckDB)."""

from pageloom import constants as K

WS = K.WS
PUNCT = f"[{K.TRAIL_PUNCT}]"
CJK = f"[{K.CJK}]"
HANGUL = f"[{K.HANGUL}]"
HANGUL_WIDE = f"[{K.HANGUL_WIDE}]"
LATIN = f"[{K.LATIN_LETTERS}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def base(x: str) -> str:
    return strip(f"regexp_replace({x}, '{PUNCT}+(\n?)\\z', '\\1')")


def nonspace(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def share(x: str, chars: str) -> str:
    body = nonspace(x)
    kept = f"length(regexp_replace({body}, '{chars}', '', 'g'))"
    return (
        f"CASE WHEN length({body}) > 0 THEN CAST(length({body}) - {kept} AS DOUBLE)"
        f" / length({body}) ELSE 0.0::DOUBLE END"
    )


def english(x: str) -> str:
    return share(x, LATIN)


def failure(x: str) -> str:
    return f"coalesce(starts_with({strip(x)}, '[翻译失败]'), false)"


def has_cjk(x: str) -> str:
    return f"(coalesce({has(x, CJK)}, false) AND NOT {failure(x)})"


def has_hangul(x: str) -> str:
    return f"coalesce({has(x, HANGUL_WIDE)}, false)"


def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def cases(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def is_sfx(raw: str, b: str, ko: str, cn: str, ko_words: str) -> str:
    """Sound-effect rule over columns holding the stripped text and its base."""
    one = f"{b} = repeat(substr({b}, 1, 1), length({b})) AND length({b}) >= 2"
    two = f"length({b}) >= 4 AND length({b}) % 2 = 0 AND {b} = repeat(substr({b}, 1, 2), CAST(length({b})/2 AS INT))"
    return f"""(CASE WHEN {raw} = '' THEN false
      WHEN {has(raw, '^[!！?？]+$')} THEN true
      WHEN {b} = '' THEN false
      WHEN upper({b}) IN ({quoted(K.SFX_EXCLUSIONS)}) THEN false
      ELSE {b} IN ({ko}) OR {b} IN ({ko_words}) OR {b} IN ({cn})
        OR upper({b}) IN ({quoted(K.SFX_EN)})
        OR {has(f'upper({raw})', '^[*]+[^\n]*[*]+\n?$')}
        OR {has(f'upper({raw})', '^(' + '|'.join(K.SFX_CAPS_WORDS) + ')!*$')}
        OR {has(f'upper({raw})', '^(HA)+!*$')} OR {has(f'upper({raw})', '^(HE)+!*$')}
        OR {has(f'upper({raw})', '^(HO)+!*$')} OR {has(f'upper({raw})', '^(HM)+!*$')}
        OR {has(f'upper({raw})', '^[A-Z]{2,4}!+$')}
        OR {has(raw, '^(咔嚓|' + cn.replace("'", '').replace(', ', '|') + ')+[！!]*$')}
        OR {has(raw, r'^[\x{3040}-\x{30FF}]{2,8}[!！]?$')}
        OR ({has(b, '^' + HANGUL + '+$')} AND (({one}) OR ({two}))) END)"""
