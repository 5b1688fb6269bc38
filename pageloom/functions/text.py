"""Splitting, joining, comparing and naming texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.constants import (
    BREAK_CHARS, CONFIG_KEYS, LANG_CODES, OVERLOAD_WORDS, SECRET_WORDS, SPLIT_PUNCT, WS,
)
from pageloom.functions.base import ColumnLike, any_of, col, is_ascii, let, literal_map, strip


def normalize_for_compare(text: ColumnLike) -> Column:
    t = strip(F.coalesce(col(text), F.lit("")))
    return F.lower(F.regexp_replace(t, f"{WS}+", " "))


def levenshtein_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """1 - edit distance over the longer length; two empty texts are equal."""
    longest = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        1 - F.levenshtein(col(a), col(b)) / longest
    )


def split_by_punctuation(text: ColumnLike) -> Column:
    """Struct (top, bottom): cut after the mark nearest the middle, else in half."""
    marks = "".join(SPLIT_PUNCT)
    unmarked = f"^[^{marks}]*"

    def cut(t: Column) -> Column:
        n = F.length(t)
        mid = F.floor(n / 2).cast("int")
        # steps from the middle to the nearest mark on either side
        head, tail = F.substring(t, F.lit(1), mid + 1), F.substring(t, mid + 2, n)
        back = F.length(F.regexp_extract(F.reverse(head), unmarked, 0))
        ahead = F.length(F.regexp_extract(tail, unmarked, 0)) + 1
        back = F.when(back < F.length(head), back)
        ahead = F.when(ahead <= F.length(tail), ahead)
        left_first = back.isNotNull() & (ahead.isNull() | (back <= ahead))
        return F.struct(t.alias("t"), n.alias("n"), mid.alias("mid"), F.when(left_first, mid - back).otherwise(mid + ahead).alias("best"))

    def sides(v: Column) -> Column:
        t, n, mid, best = v["t"], v["n"], v["mid"], v["best"]
        return F.struct(
            n.alias("n"), strip(F.substring(t, F.lit(1), best + 1)).alias("left"), strip(F.substring(t, best + 2, n)).alias("right"),
            F.substring(t, F.lit(1), mid).alias("half_left"), F.substring(t, mid + 1, n).alias("half_right"),
        )

    def choose(v: Column) -> Column:
        good = F.coalesce((F.length(v["left"]) >= 2) & (F.length(v["right"]) >= 2), F.lit(False))
        pair = lambda a, b: F.struct(a.alias("top"), b.alias("bottom"))
        return F.when(v["n"] <= 4, pair(v["half_left"], v["half_right"])).when(good, pair(v["left"], v["right"])).otherwise(
            pair(strip(v["half_left"]), strip(v["half_right"]))
        )

    def halves(t: Column) -> Column:
        n, mid = F.length(t), F.floor(F.length(t) / 2).cast("int")
        left, right = F.substring(t, F.lit(1), mid), F.substring(t, mid + 1, n)
        pair = lambda a, b: F.struct(a.alias("top"), b.alias("bottom"))
        return F.when(n <= 4, pair(left, right)).otherwise(pair(strip(left), strip(right)))

    # most texts hold no mark, and need none of its search
    return let(strip(F.coalesce(col(text), F.lit(""))), lambda t: F.when(
        t.rlike(f"[{marks}]"), let(let(let(t, cut), sides), choose)).otherwise(halves(t)))


def split_by_ratio(sources: ColumnLike, translation: ColumnLike) -> Column:
    """Share a reply among its sources by their length.

    Each cut moves back up to 10 characters to stand after a break character.
    The last source takes the rest.
    """
    lengths = F.transform(col(sources), lambda s: F.length(strip(F.coalesce(s, F.lit("")))))
    t = F.coalesce(col(translation), F.lit(""))

    def share(v: Column) -> Column:
        lengths, t, n, size, total = v["lengths"], v["t"], v["n"], v["size"], v["total"]

        def cut(acc: Column, i: Column) -> Column:
            start = acc["start"]
            end = start + F.floor(size * (F.element_at(lengths, i) / total)).cast("int")
            steps = F.when(
                end > start, F.sequence(F.lit(0), F.least(F.lit(10), end - start) - 1)
            ).otherwise(F.array().cast("array<int>"))
            back = F.array_min(F.filter(
                steps,
                lambda k: (end - k > start) & (end - k < size)
                & F.lit(BREAK_CHARS).contains(F.substring(t, end - k + 1, F.lit(1))),
            ))
            stop = F.when(i == n, size).otherwise(F.coalesce(end - back + 1, end))
            part = F.substring(t, start + 1, stop - start)
            return F.struct(
                stop.alias("start"), F.concat(acc["parts"], F.array(part)).alias("parts")
            )

        zero = F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(F.sequence(F.lit(1), n), zero, cut)["parts"]

    bound = F.struct(
        lengths.alias("lengths"), t.alias("t"), F.size(lengths).alias("n"),
        F.length(t).alias("size"),
        F.aggregate(lengths, F.lit(0), lambda a, x: a + x).alias("total"),
    )

    def choose(v: Column) -> Column:
        even = F.floor(v["size"] / v["n"]).cast("int")
        return (
            F.when(v["n"] == 0, F.array().cast("array<string>"))
            .when(v["n"] == 1, F.array(v["t"]))
            .when(v["size"] == 0, F.array_repeat(F.lit(""), v["n"]))
            .when(
                v["total"] == 0,
                F.transform(v["lengths"], lambda _, i: F.substring(v["t"], i * even + 1, even)),
            )
            .otherwise(share(v))
        )

    return let(bound, choose)


def parse_top_bottom(text: ColumnLike) -> Column:
    """Struct (top, bottom) from a JSON reply, also a truncated one; else null."""
    raw = strip(F.coalesce(col(text), F.lit("")))
    parsed = F.when(
        raw.startswith("{") & raw.endswith("}"), F.from_json(raw, "map<string,string>")
    )

    def salvage(name: str) -> Column:
        head = f'"{name}"{WS}*:{WS}*"'
        body = F.regexp_extract(raw, f'(?s){head}((?:[^"\\\\]|\\\\.)*)', 1)
        return F.when(raw.rlike(head), F.regexp_replace(body, r"(?s)\\(.)", "$1"))

    def field(name: str) -> Column:
        whole = strip(F.coalesce(F.try_element_at(parsed, F.lit(name)), F.lit("")))
        part = strip(F.coalesce(salvage(name), F.lit("")))
        return F.when(parsed.isNotNull(), whole).otherwise(part).alias(name)

    usable = parsed.isNotNull() | salvage("top").isNotNull() | salvage("bottom").isNotNull()
    return F.when(usable, F.struct(field("top"), field("bottom")))


def join_script_aware(texts: ColumnLike) -> Column:
    """Join lines; only ASCII neighbours get a space between them."""
    kept = F.filter(
        F.transform(F.coalesce(col(texts), F.array().cast("array<string>")), strip),
        lambda s: s != "",
    )
    return F.aggregate(
        kept,
        F.lit(""),
        lambda out, s: F.when(out == "", s)
        .when(is_ascii(F.substring(out, -1, 1)) & is_ascii(F.substring(s, 1, 1)), F.concat(out, F.lit(" "), s))
        .otherwise(F.concat(out, s)),
    )


def mask_text(text: ColumnLike, mode: str = "off", limit: int = 120) -> Column:
    """Privacy projection of a text: off, full, hash or snippet."""
    t = col(text)
    mode = mode.strip().lower()
    if mode == "full":
        shown = t
    elif mode == "hash":
        shown = F.concat(F.lit("sha256:"), F.sha2(t, 256), F.lit(" len="), F.length(t).cast("string"))
    elif mode == "snippet" and limit <= 0:
        shown = F.lit("")
    elif mode == "snippet":
        ends = F.concat(F.substring(t, 1, limit), F.lit("..."), F.substring(t, -limit, limit))
        shown = F.when(F.length(t) <= 2 * limit, t).otherwise(ends)
    else:
        shown = F.lit(None).cast("string")
    return F.when(t.isNull(), F.lit("")).otherwise(shown)


def lang_code(lang: ColumnLike, for_target: bool = True) -> Column:
    key = strip(col(lang))
    known = F.try_element_at(literal_map(LANG_CODES), F.lower(key))
    mapped = F.coalesce(known, key)
    if for_target:
        return mapped
    return F.when(F.lower(key) == "auto", F.lit("auto")).otherwise(mapped)


def token_budget(items: ColumnLike, chars: ColumnLike, cap: int = 4000) -> Column:
    """Reply size allowance for a batch."""
    n = F.greatest(F.lit(1), F.coalesce(col(items), F.lit(0)))
    size = F.greatest(F.lit(0), F.coalesce(col(chars), F.lit(0)))
    want = 320 + 120 * n + F.floor(size / 200) * 40
    return F.greatest(F.lit(320), F.least(F.lit(cap), want)).cast("long")


def natural_number(name: ColumnLike) -> Column:
    """First number in a name, 0 without one."""
    return F.coalesce(F.regexp_extract(col(name), r"(\d+)", 1).try_cast("long"), F.lit(0))


def natural_chunks(name: ColumnLike) -> Column:
    """Sort key that orders number chunks by value and text chunks by lower case."""
    chunks = F.regexp_extract_all(col(name), F.lit(r"(\d+|\D+)"), 1)
    return F.transform(
        chunks,
        lambda s: F.struct(
            s.try_cast("long").isNull().alias("is_text"),
            s.try_cast("long").alias("number"),
            F.lower(s).alias("text"),
        ),
    )


def is_overload_error(message: ColumnLike) -> Column:
    msg = F.lower(F.coalesce(col(message), F.lit("")))
    return any_of([msg.contains(w) for w in OVERLOAD_WORDS])


def sanitize_component(text: ColumnLike) -> Column:
    t = F.regexp_replace(F.lower(strip(col(text))), "[^a-z0-9_-]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, "^_+", ""), "_+\\z", "")
    return F.when(t == "", F.lit("unknown")).otherwise(t)


def file_stem(name: ColumnLike) -> Column:
    return F.regexp_replace(col(name), r"^(.+)\.[^.]+\z", "$1")


def source_slug(path: ColumnLike) -> Column:
    """Report name part: up to three path parts after data/ or data/raw/."""
    p = col(path)
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    parts = F.when(p.startswith("/"), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)
    n = F.size(parts)
    at = F.array_position(parts, F.lit("data")).cast("int")
    raw_next = F.coalesce(F.try_element_at(parts, at + 1) == "raw", F.lit(False))
    skip = F.when(at == 0, n).when(raw_next, at + 1).otherwise(at)
    first = F.when(skip >= n, F.greatest(n - 2, F.lit(1))).otherwise(
        F.greatest(skip + 1, n - 2)
    )
    rel = F.slice(parts, first, F.lit(3))
    size = F.size(rel)
    named = F.transform(
        rel, lambda s, i: sanitize_component(F.when(i == size - 1, file_stem(s)).otherwise(s))
    )
    slug = F.concat_ws("__", named)
    # the hash keeps long paths with the same end apart
    short = F.concat(F.substring(F.sha2(col(path), 256), 1, 12), F.lit("__"), F.substring(slug, -106, 106))
    return F.when(F.length(slug) > 120, short).otherwise(slug)


def coerce_confidence(score: ColumnLike) -> Column:
    """A number, or the first of a bracketed list; null when unusable."""
    t = strip(col(score).cast("string"))
    first = F.regexp_extract(t, r"^[\[(]\s*([^,\])\s]*)", 1)
    return F.when(t.rlike(r"^[\[(]"), first).otherwise(t).try_cast("double")


def redact_config(config: ColumnLike) -> Column:
    """Keep the attribution settings and never a secret."""
    return F.map_filter(
        col(config),
        lambda k, v: k.isin(*CONFIG_KEYS) & v.isNotNull()
        & ~any_of([F.upper(k).contains(w) for w in SECRET_WORDS]),
    )
