"""Text functions over every text of the corpus: documents, sources, replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import query
from pageloom import constants as K
from pageloom.functions import base, cleaning, noise, script, sfx, text

TEXTS = """, texts AS (
  SELECT 'document' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'source', region_id, source_text FROM regions
  UNION ALL SELECT 'target', region_id, target_text FROM regions)
"""


def texts(t) -> DataFrame:
    """Whole documents and both texts of every region, as one long table."""
    docs = t.spread("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    both = t.regions.select(
        "region_id",
        F.explode(F.array(
            F.struct(F.lit("source").alias("kind"), F.col("source_text").alias("text")),
            F.struct(F.lit("target").alias("kind"), F.col("target_text").alias("text")),
        )).alias("side"),
    ).select("side.kind", F.col("region_id").alias("id"), "side.text")
    return docs.unionByName(both)


def _over_texts(name: str, sql: str, make, column: str = "value") -> None:
    """One query that applies one function to every text."""
    @query(name, TEXTS + f"SELECT kind, id, {sql} AS {column} FROM texts", ("regions",))
    def run(t):
        return texts(t).select("kind", "id", make(F.col("text")).alias(column))


KO = S.quoted(K.SFX_KO)
KO_WORDS = S.quoted(K.SFX_KO_WORDS)
CN = S.quoted(sorted(K.SFX_CN_WORDS, key=len, reverse=True))
KO_MAP_SQL = S.cases("key", K.SFX_KO)
EN_MAP_SQL = S.cases("upper(key)", K.SFX_EN)

_over_texts("has_cjk", S.has_cjk("text"), script.has_cjk)
_over_texts("has_hangul", S.has_hangul("text"), script.has_hangul)
_over_texts("hangul_ratio", f"CASE WHEN text IS NULL THEN 0.0::DOUBLE ELSE {S.share('text', S.HANGUL_WIDE)} END", script.hangul_ratio)
_over_texts("english_ratio", f"CASE WHEN text IS NULL THEN 0.0::DOUBLE ELSE {S.english('text')} END", script.english_ratio)
_over_texts(
    "script_bucket",
    f"""CASE WHEN {S.has('text', S.HANGUL)}::INT + {S.has('text', '[A-Za-z]')}::INT + {S.has('text', S.CJK)}::INT > 1 THEN 'mixed'
        WHEN {S.has('text', S.HANGUL)} THEN 'hangul' WHEN {S.has('text', '[A-Za-z]')} THEN 'latin'
        WHEN {S.has('text', S.CJK)} THEN 'cjk' END""",
    script.script_bucket,
)
_over_texts(
    "script_type",
    f"""CASE WHEN {S.has('text', S.HANGUL)} THEN 'ko' WHEN {S.has('text', '[\\x{3040}-\\x{30FF}]')} THEN 'jp'
        WHEN {S.has('text', S.CJK)} THEN 'cn' WHEN NOT {S.has('text', '[^\\x{00}-\\x{7F}]')} THEN 'ascii'
        WHEN text IS NOT NULL THEN 'other' END""",
    script.script_type,
)
_over_texts("strip_trailing_punct", S.base("text"), base.strip_trailing_punct)
_over_texts(
    "split_trailing_punct",
    f"regexp_replace(text, '{S.PUNCT}+\n?\\z', '') || '|' || regexp_extract(text, '({S.PUNCT}+)\n?\\z', 1)",
    lambda c: F.concat(base.before_trailing_punct(c), F.lit("|"), base.trailing_punct(c)),
)

RAW_BASE = TEXTS + f", rb AS (SELECT kind, id, {S.strip('coalesce(text, chr(0))')} AS r0, text FROM texts), "
RAW_BASE = TEXTS + f""", raws AS (SELECT kind, id, {S.strip("coalesce(text, '')")} AS raw FROM texts),
  bases AS (SELECT kind, id, raw, {S.base('raw')} AS base FROM raws)
"""
SFX_SQL = S.is_sfx("raw", "base", KO, CN, KO_WORDS)


@query("is_sfx", RAW_BASE + f"SELECT kind, id, {SFX_SQL} AS value FROM bases", ("regions",))
def _(t):
    return texts(t).select("kind", "id", sfx.is_sfx("text").alias("value"))


@query("translate_sfx", TEXTS + f""", raws AS (
    SELECT kind, id, {S.strip("coalesce(text, '')")} AS raw FROM texts),
  keys AS (SELECT kind, id, raw, {S.strip(f"regexp_replace(raw, '{S.PUNCT}+$', '')")} AS key,
    regexp_extract(raw, '({S.PUNCT}+)$', 1) AS tail FROM raws)
SELECT kind, id, CASE WHEN key = '' THEN raw
  ELSE coalesce({EN_MAP_SQL}, {KO_MAP_SQL}, key) || tail END AS value FROM keys""", ("regions",))
def _(t):
    return texts(t).select("kind", "id", sfx.translate_sfx("text").alias("value"))


ROMAN = r"^[\x{2160}-\x{2188}]+$"
SPACED = f"{S.has('base', '^\\p{Nd}+(' + S.WS + '+\\p{Nd}+)+$')} AND length({S.nonspace('base')}) <= 4"


@query("ocr_noise_reason", RAW_BASE + f"""SELECT kind, id, CASE WHEN raw = '' THEN '空文本'
    WHEN {SFX_SQL} OR base = '' THEN NULL
    WHEN {S.has('base', '[\\\\$^_{}]')} THEN '符号噪声'
    WHEN {S.has('base', '^[A-Z]{2}$')} THEN '短大写缩写'
    WHEN {S.has('base', '^[A-Za-z]{1,2}[0-9]{2,4}$')} THEN '短字母数字'
    WHEN {S.has('base', '^\\p{Nd}+$')} AND length(base) <= 3 THEN '短数字'
    WHEN {SPACED} THEN '分隔数字' WHEN {S.has('base', ROMAN)} THEN '罗马数字' END AS value FROM bases""", ("regions",))
def _(t):
    return texts(t).select("kind", "id", noise.ocr_noise_reason("text").alias("value"))


@query("merge_noise", RAW_BASE + f"""SELECT kind, id, base <> '' AND (
    {S.has('base', '[\\\\$^_{}]')} OR {S.has('base', '^[A-Z]{2}$')}
    OR {S.has('base', '^[A-Za-z]{1,2}[0-9]{2,4}$')}
    OR ({S.has('base', '^\\p{Nd}+$')} AND length(base) <= 3) OR ({SPACED})
    OR {S.has('base', ROMAN)}) AS value FROM bases""", ("regions",))
def _(t):
    return texts(t).select("kind", "id", noise.merge_noise("text").alias("value"))


_over_texts(
    "skip_translation_reason",
    f"""CASE WHEN {S.strip("coalesce(text, '')")} = '' THEN '空文本'
      WHEN {S.has(S.strip('text'), '^[^\\p{L}\\p{Nl}\\p{No}_]+$')} THEN '纯数字/符号'
      WHEN {S.has(S.strip('text'), ROMAN)} THEN '罗马数字' END""",
    noise.skip_translation_reason,
)


@query("noise_reason", f""", b AS (SELECT *, {S.base('source_text')} AS base, x2 - x1 AS w, y2 - y1 AS h FROM regions),
  s AS (SELECT *, CASE WHEN source_text IS NULL OR source_text = '' THEN 'missing' WHEN base = '' THEN 'empty'
    WHEN w < 15 OR h < 10 THEN 'size'
    WHEN w / greatest(h, 1) > 20 OR w / greatest(h, 1) < 0.05 THEN 'aspect'
    WHEN length(source_text) <= 3 AND confidence < 0.85 AND NOT {S.has('source_text', '[^\\x{00}-\\x{7F}]')} THEN 'short_ascii'
    WHEN {S.has('base', '^[0-9,.]+$')} AND (length(base) >= 4 OR contains(base, ',') OR y1 > 2000 * 0.8 OR w > h * 3) THEN 'price'
    WHEN {S.has('base', '^[0OoSs]+$')} THEN 'zeros'
    WHEN {S.has('base', '(?i)\\.(com|net|org|io|cn)$')} THEN 'domain'
    WHEN {S.has('base', '^[A-Z]+SCANS?$')} OR {S.has('base', '^[A-Z]+COMICS?$')} THEN 'credit'
    WHEN NOT {S.has('base', '[^\\x{00}-\\x{7F}]')} AND length(base) > 15 AND NOT contains(base, ' ') AND NOT {S.has('base', '[a-z]')} THEN 'caps_run'
    WHEN {S.has('base', '[\\\\$^_{}]')} THEN 'symbol'
    WHEN {S.has('base', '^[A-Za-z]{1,2}[0-9]{2,4}$')} THEN 'alnum_short'
    WHEN {SPACED} THEN 'spaced_digits'
    WHEN {S.has('base', '^[A-Z]{3,4}' + S.WS + '[A-Z][a-z]-[A-Z][a-z],?$')} THEN 'weird_split'
    WHEN {S.has('base', ROMAN)} THEN 'roman'
    WHEN {S.has('base', '^[-\\x{2212}\\x{2013}\\x{2014}]+$')} OR {S.has('base', '^[I1l|]+$')} OR {S.has('base', '^[.]+$')}
      OR {S.has('base', '^[A-Za-z]$')} OR {S.has('base', '^[A-Za-z][0-9][.]$')} OR {S.has('base', '^[A-Z]{2}$')}
      OR {S.has('base', '^[a-z][0-9]$')} OR {S.has('base', '^0+[A-Za-z]+$')} OR {S.has('base', '^[A-Za-z]+0+$')} THEN 'pattern' END AS strict,
    CASE WHEN source_text IS NULL OR source_text = '' THEN 'missing' WHEN base = '' THEN 'empty'
    WHEN {S.has('base', '^[0OoSs]+$')} THEN 'zeros'
    WHEN {S.has('base', '^[-\\x{2212}\\x{2013}\\x{2014}]+$')} OR {S.has('base', '^[I1l|]+$')} OR {S.has('base', '^[.]+$')} THEN 'pattern' END AS relaxed
  FROM b)
SELECT region_id, strict, relaxed FROM s""", ("regions",))
def _(t):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    args = ("source_text", w, h, "y1", "confidence", 2000)
    return t.regions.select(
        "region_id", noise.noise_reason(*args).alias("strict"),
        noise.noise_reason(*args, relaxed=True).alias("relaxed"),
    )


@query("detection_reject", f"""SELECT region_id,
  CASE WHEN {S.strip('source_text')} = '' THEN 'empty' WHEN confidence < 0.5 THEN 'low_score'
    WHEN length({S.strip('source_text')}) < 2 THEN 'too_short'
    WHEN {S.has(S.strip('source_text'), '^[-.,;:''"!?()\\[\\]{}|/\\\\]+$')} THEN 'punctuation' END AS reason
  FROM regions""", ("regions",))
def _(t):
    return t.regions.select(
        "region_id", noise.detection_reject("source_text", "confidence", 0.5, F.lit("en")).alias("reason")
    )


def _replaced(x: str) -> str:
    for wrong, right in K.KO_FIXES:
        x = f"replace({x}, '{wrong}', '{right}')"
    return x


NORMAL = S.strip(f"regexp_replace(coalesce(text, ''), '{S.WS}+', ' ', 'g')")


@query("normalize_text", TEXTS + f"""SELECT kind, id,
  CASE WHEN kind = 'document' THEN {NORMAL} ELSE {_replaced(NORMAL)} END AS value FROM texts""", ("regions",))
def _(t):
    lang = F.when(F.col("kind") == "document", "en").otherwise("ko")
    return texts(t).select("kind", "id", cleaning.normalize_text("text", lang).alias("value"))


_over_texts(
    "watermark_compact",
    f"regexp_replace(lower(coalesce(text, '')), '({S.WS}|[-._:·•])+', '', 'g')",
    cleaning.watermark_compact,
)


def _annotations(x: str) -> str:
    for s in K.ANNOTATIONS:
        x = f"regexp_replace({x}, '{s}', '', 'g')"
    return S.strip(x)


ANNOTATED = (
    "CASE id % 5 WHEN 0 THEN 'TEXT: ' || coalesce(text, '') || ' (Note: kept short)'"
    " WHEN 1 THEN coalesce(text, '') || ' (注：说明' WHEN 2 THEN '翻译：' || coalesce(text, '') || ' CTX: more'"
    " WHEN 3 THEN 'This seems to be a name. ' || coalesce(text, '') ELSE coalesce(text, '') END"
)


def _annotated(c):
    t = F.coalesce(c, F.lit(""))
    which = F.col("id") % 5
    return (
        F.when(which == 0, F.concat(F.lit("TEXT: "), t, F.lit(" (Note: kept short)")))
        .when(which == 1, F.concat(t, F.lit(" (注：说明")))
        .when(which == 2, F.concat(F.lit("翻译："), t, F.lit(" CTX: more")))
        .when(which == 3, F.concat(F.lit("This seems to be a name. "), t))
        .otherwise(t)
    )


_over_texts("clean_annotations", _annotations(f"({ANNOTATED})"), lambda c: cleaning.clean_annotations(_annotated(c)))
_over_texts(
    "clean_input",
    r"regexp_replace(coalesce(text, ''), '[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]', '', 'g')",
    cleaning.clean_input,
)

_hits = " + ".join(f"contains(lower(o), '{h}')::INT" for h in K.PROMPT_HINTS)


@query("is_prompt_artifact", TEXTS + f""", o AS (SELECT kind, id, {S.strip("coalesce(text, '')")} AS o FROM texts),
  f AS (SELECT kind, id, o, lower(o) AS l, {_hits} AS hits, {S.english('o')} AS eng FROM o)
SELECT kind, id, length(o) >= 24 AND NOT starts_with(o, '[翻译失败]') AND hits > 0 AND (
   ((contains(l, 'assistant') OR contains(l, 'translate') OR contains(l, 'output only')) AND eng >= 0.15)
   OR (contains(o, '不要') AND (contains(l, 'output') OR contains(l, 'translate')))
   OR (hits >= 2 AND eng >= 0.2)) AS value FROM f""", ("regions",))
def _(t):
    return texts(t).select("kind", "id", cleaning.is_prompt_artifact("text").alias("value"))


SRC, OUT = S.strip("source_text"), S.strip("coalesce(target_text, '')")


@query("skip_retranslate", f""", p AS (SELECT region_id, {SRC} AS s, {OUT} AS o FROM regions)
SELECT region_id, s <> '' AND NOT starts_with(o, '[翻译失败]') AND (
  {S.has('s', '(?i)(https?://|www[.]|discord[.]gg/)')} OR {S.has('s', '(?i)^[\\x{2160}-\\x{2188}IVXLCDM]+$')}
  OR {S.has('s', '^[A-Za-z][A-Za-z0-9._-]{0,5}$')} OR {S.has('s', '^[A-Za-z0-9]{1,4}$')}
  OR (NOT contains(s, ' ') AND length(s) <= 12 AND o = s)) AS value FROM p""", ("regions",))
def _(t):
    return t.regions.select("region_id", cleaning.skip_retranslate("source_text", "target_text").alias("value"))


NEEDS = (
    f"(NOT {S.has_cjk('target_text')} OR {S.has_hangul('target_text')} OR "
    + S.english("coalesce(target_text, '')") + " >= 0.35)"
)
KIND = f"""CASE WHEN coalesce(target_text, '') = '' THEN 'empty' WHEN target_text = '[INPAINT_ONLY]' THEN 'erase'
  WHEN {S.failure('target_text')} THEN 'failure' WHEN starts_with(target_text, '[SFX:') THEN 'sfx' ELSE 'text' END"""


@query("reply_flags", f"""SELECT region_id, {NEEDS} AS needs_fallback, {KIND} AS text_kind,
  region_id % 9 = 0 OR (coalesce(target_text, '') <> '' AND NOT {S.failure('target_text')}
    AND NOT (starts_with(target_text, '[SFX:') AND ends_with(target_text, ']'))) AS should_erase
  FROM regions""", ("regions",))
def _(t):
    mode = F.when(F.col("region_id") % 9 == 0, "erase").otherwise("replace")
    return t.regions.select(
        "region_id", cleaning.needs_fallback("target_text").alias("needs_fallback"),
        cleaning.text_kind("target_text").alias("text_kind"),
        cleaning.should_erase("target_text", mode).alias("should_erase"),
    )


@query("validate_output", f""", c AS (SELECT region_id, coalesce(source_text, '') AS src,
    {_annotations("coalesce(target_text, '')")} AS out FROM regions)
SELECT region_id, CASE WHEN out = '' OR {S.has('out', S.HANGUL)}
   OR ({S.has('src', S.HANGUL)} AND NOT {S.has('out', S.CJK)}) THEN '[翻译失败]' ELSE out END AS value FROM c""", ("regions",))
def _(t):
    return t.regions.select("region_id", cleaning.validate_output("source_text", "target_text").alias("value"))


@query("levenshtein_ratio")
def _(t):
    pair = t.regions.select(
        "region_id", text.normalize_for_compare("source_text").alias("a"),
        text.normalize_for_compare(F.col("target_text")).alias("b"),
    )
    return pair.select("region_id", text.levenshtein_ratio("a", "b").alias("similarity"))


@query("split_by_punctuation", TEXTS + f""", s AS (SELECT kind, id, {S.strip("coalesce(text, '')")} AS s FROM texts),
  m AS (SELECT kind, id, s, length(s) AS n, length(s) // 2 AS mid,
    list_min(list_filter(list_transform(string_split(s, ''), lambda ch, i: CASE WHEN ch IN ('。','！','？','…','；','，')
      THEN abs(i - 1 - length(s) // 2) * 10000000 + i - 1 END), lambda v: v IS NOT NULL)) % 10000000 AS cutpos FROM s),
  c AS (SELECT *, {S.strip('substr(s, 1, cutpos + 1)')} AS l, {S.strip('substr(s, cutpos + 2)')} AS r FROM m)
SELECT kind, id, CASE WHEN n <= 4 THEN substr(s, 1, mid) WHEN length(l) >= 2 AND length(r) >= 2 THEN l
    ELSE {S.strip('substr(s, 1, mid)')} END AS top,
  CASE WHEN n <= 4 THEN substr(s, mid + 1) WHEN length(l) >= 2 AND length(r) >= 2 THEN r
    ELSE {S.strip('substr(s, mid + 1)')} END AS bottom FROM c""", ("regions",))
def _(t):
    cut = texts(t).select("kind", "id", text.split_by_punctuation("text").alias("cut"))
    return cut.select("kind", "id", "cut.top", "cut.bottom")


@query("mask_text", TEXTS + """SELECT kind, id, coalesce(text, '') AS full_text,
   CASE WHEN text IS NULL THEN '' END AS off,
   CASE WHEN text IS NULL THEN '' ELSE 'sha256:' || sha256(text) || ' len=' || length(text) END AS hashed,
   CASE WHEN text IS NULL THEN '' WHEN length(text) <= 10 THEN text
     ELSE substr(text, 1, 5) || '...' || substr(text, length(text) - 4) END AS snippet FROM texts""", ("regions",))
def _(t):
    return texts(t).select(
        "kind", "id", text.mask_text("text", "full").alias("full_text"),
        text.mask_text("text", "off").alias("off"), text.mask_text("text", "hash").alias("hashed"),
        text.mask_text("text", "snippet", 5).alias("snippet"),
    )


@query("lang_code", """SELECT doc_id, CASE lang WHEN 'en' THEN 'en' ELSE lang END AS plain,
   CASE doc_id % 4 WHEN 0 THEN 'zh-CN' WHEN 1 THEN 'ko' WHEN 2 THEN 'zh-TW' ELSE lang END AS mapped,
   CASE doc_id % 4 WHEN 0 THEN 'zh-CN' WHEN 1 THEN 'auto' WHEN 2 THEN 'ja' ELSE lang END AS from_source
   FROM documents""")
def _(t):
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names], F.col("lang")), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select(
        "doc_id", text.lang_code("lang").alias("plain"),
        text.lang_code(pick("ZH ", "Korean", "zh-Hant")).alias("mapped"),
        text.lang_code(pick("chinese", "AUTO", "japanese"), for_target=False).alias("from_source"),
    )


@query("token_budget", """SELECT doc_id, CAST(greatest(320, least(4000, 320 + 120 * greatest(1, doc_id % 30)
   + (length(text) // 200) * 40)) AS BIGINT) AS budget FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.token_budget(F.col("doc_id") % 30, F.length("text")).alias("budget"))


@query("natural_number", """SELECT page_id, CAST(coalesce(nullif(regexp_extract(url, '([0-9]+)', 1), ''), '0') AS BIGINT) AS number FROM pages""")
def _(t):
    return t.pages.select("page_id", text.natural_number("url").alias("number"))


@query("natural_order")
def _(t):
    """Position of every page name among all names of its site, in natural order."""
    from pageloom.operators.ordering import natural_positions
    from pageloom.functions.urls import url_host
    named = t.pages.select("page_id", "url", url_host("url").alias("host"))
    return natural_positions(named, ["host"], "url", "page_id").select("page_id", "host", "position")


@query("is_overload_error", TEXTS + """SELECT kind, id, contains(m, '503') OR contains(m, 'unavailable') OR contains(m, 'overload')
   OR contains(m, 'timeout') OR contains(m, 'timed out') OR contains(m, 'empty response') AS value
   FROM (SELECT kind, id, lower(coalesce(text, '')) || CASE id % 7 WHEN 0 THEN ' error 503' WHEN 1 THEN ' request timed out' ELSE '' END AS m FROM texts)""", ("regions",))
def _(t):
    tail = F.when(F.col("id") % 7 == 0, " Error 503").when(F.col("id") % 7 == 1, " Request Timed Out").otherwise("")
    return texts(t).select("kind", "id", text.is_overload_error(F.concat(F.coalesce("text", F.lit("")), tail)).alias("value"))


@query("source_slug", r"""WITH p AS (SELECT page_id, CASE page_id % 4
    WHEN 0 THEN 'data/raw/Series ' || page_id % 9 || '/Chapter-' || page_id % 5 || '/' || page_id || '.jpg'
    WHEN 1 THEN '/srv/data/set/' || page_id || '.tar.png' WHEN 2 THEN page_id || '.webp'
    ELSE '/a/b' || page_id || '/c d/é' || page_id || '.png' END AS path FROM pages)
 SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'series_' || page_id % 9 || '__chapter-' || page_id % 5 || '__' || page_id
   WHEN 1 THEN 'set__' || page_id || '_tar' WHEN 2 THEN CAST(page_id AS VARCHAR)
   ELSE 'b' || page_id || '__c_d__' || page_id END AS slug FROM p""")
def _(t):
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 4
    path = (
        F.when(m == 0, F.concat(F.lit("data/raw/Series "), (F.col("page_id") % 9).cast("string"), F.lit("/Chapter-"), (F.col("page_id") % 5).cast("string"), F.lit("/"), i, F.lit(".jpg")))
        .when(m == 1, F.concat(F.lit("/srv/data/set/"), i, F.lit(".tar.png")))
        .when(m == 2, F.concat(i, F.lit(".webp")))
        .otherwise(F.concat(F.lit("/a/b"), i, F.lit("/c d/é"), i, F.lit(".png")))
    )
    return t.pages.select("page_id", text.source_slug(path).alias("slug"))


@query("coerce_confidence", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN NULL ELSE NULL END AS score FROM events""")
def _(t):
    v, m = F.col("value").cast("string"), F.col("event_id") % 4
    raw = F.when(m == 0, v).when(m == 1, F.concat(F.lit("["), v, F.lit(", 0.2]"))).when(m == 2, "n/a").otherwise("[]")
    return t.events.select("event_id", text.coerce_confidence(raw).alias("score"))


@query("redact_config", """SELECT event_id, 'gemini' AS provider, CAST(event_id % 8 AS VARCHAR) AS inflight, 2 AS kept FROM events""")
def _(t):
    config = F.create_map(
        F.lit("AI_PROVIDER"), F.lit("gemini"), F.lit("GEMINI_API_KEY"), F.col("props"),
        F.lit("AI_TRANSLATE_MAX_INFLIGHT_CALLS"), (F.col("event_id") % 8).cast("string"),
        F.lit("HOME"), F.col("event_type"),
    )
    kept = t.events.select("event_id", text.redact_config(config).alias("config"))
    return kept.select(
        "event_id", F.col("config")["AI_PROVIDER"].alias("provider"),
        F.col("config")["AI_TRANSLATE_MAX_INFLIGHT_CALLS"].alias("inflight"),
        F.size("config").alias("kept"),
    )
