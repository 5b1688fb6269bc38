"""Articles, links, images and listings from the node table of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom import constants as K
from pageloom.functions.base import any_of, col, strip
from pageloom.functions.urls import (
    infer_id_or_hash, infer_id_or_host, is_content_url, looks_like_challenge, normalize_url,
)

def _attr(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


def clean_text(text: Column | str) -> Column:
    return strip(F.regexp_replace(col(text), f"{K.WS}+", " "))


def split_paragraphs(text: Column | str) -> Column:
    """Paragraphs by blank lines; without text between them, lines."""
    pieces = F.filter(F.transform(F.split(col(text), "\n{2,}"), strip), lambda s: s != "")
    lines = F.filter(F.transform(F.split(col(text), "\r\n|\n|\r"), strip), lambda s: s != "")
    return F.when(F.size(pieces) > 0, pieces).otherwise(lines)


# ---------------------------------------------------------------------------
# structured data
# ---------------------------------------------------------------------------

def _text_of(value: Column, *names: str) -> Column:
    """A JSON value as text: a string, a named field, or the first of a list."""
    kind = F.substring(strip(value), 1, 1)
    inner = F.coalesce(*[F.get_json_object(value, f"$.{n}") for n in names])
    first = F.get_json_object(value, "$[0]")
    first_inner = F.coalesce(*[F.get_json_object(first, f"$.{n}") for n in names], first)
    return F.when(kind == "{", inner).when(kind == "[", first_inner).otherwise(value)


def _names_of(value: Column) -> Column:
    """Author names: of one author, or of a list joined with commas."""
    kind = F.substring(strip(value), 1, 1)
    listed = F.from_json(value, "array<string>")
    name = lambda v: F.when(
        F.substring(strip(v), 1, 1) == "{",
        F.coalesce(F.get_json_object(v, "$.name"), F.get_json_object(v, "$.givenName")),
    ).otherwise(v)
    names = F.filter(F.transform(listed, name), lambda s: s.isNotNull() & (s != ""))
    return F.when(kind == "[", F.concat_ws(", ", names)).otherwise(name(value))


def _best_item(text: Column) -> Column:
    """Best-scored item of one structured-data block: a struct that sorts best first, null without one.

    Graphs and lists are flattened; ties go to the first item.
    """
    get = lambda item, n: F.get_json_object(item, f"$['{n}']")

    def ranked(item: Column, i: Column, j: Column) -> Column:
        kinds = get(item, "@type")
        types = F.when(kinds.startswith("["), F.from_json(kinds, "array<string>")).otherwise(F.array(kinds))
        filled = lambda *n: any_of([F.coalesce(get(item, x) != "", F.lit(False)) for x in n]).cast("int")
        score = (
            3 * F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(t) for t in K.ARTICLE_TYPES])), F.lit(False)).cast("int")
            + 4 * filled("articleBody") + 2 * filled("headline", "name") + filled("datePublished") + filled("description")
        )
        return F.struct((-score).alias("worse"), i.alias("i"), j.alias("j"), item.alias("item"))

    tops = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    graph = lambda top: F.coalesce(F.from_json(get(top, "@graph"), "array<string>"), F.array(top))
    items = F.flatten(F.transform(tops, lambda top, i: F.transform(graph(top), lambda item, j: ranked(item, i, j))))
    return F.array_min(F.filter(items, lambda r: F.coalesce(r["item"].startswith("{"), F.lit(False))))


def _page_item() -> Column:
    """The best item of a page: ties go to the first block."""
    kept = (F.col("kind") == "jsonld") & (F.col("text") != "")
    best = _best_item(F.when(kept, F.col("text")))
    # without the condition a null still becomes a struct of nulls, which sorts first
    return F.min(F.when(best.isNotNull(), F.struct(best["worse"].alias("worse"), "pos", best["i"], best["j"], best["item"].alias("item"))))


def pick_jsonld(nodes: DataFrame) -> DataFrame:
    """The best-scored item of each page; ties go to the first."""
    best = nodes.where("kind = 'jsonld'").groupBy("page_id").agg(_page_item().alias("b")).where("b IS NOT NULL")
    return best.select("page_id", "b.item", (-F.col("b.worse")).alias("score"))


# ---------------------------------------------------------------------------
# articles
# ---------------------------------------------------------------------------

def _page_block() -> Column:
    """The block with the highest length + 25 * paragraphs; the body when a page has no block."""
    score = F.col("length") + 25 * F.col("paragraphs")
    body = (F.col("tag") == "body").cast("int")
    # a body competes only where nothing else does
    return F.min(F.when(F.col("kind") == "block", F.struct(
        body.alias("body"), (-score).alias("worse"), "pos", "last", "first", "stop"
    )))


def _page_texts() -> Column:
    """The shown texts of a page and the intervals of its paragraphs."""
    return F.min(F.when(F.col("kind") == "page", F.struct("texts", "spans")))


def _block_paragraphs(block: Column, page: Column) -> Column:
    """Texts of the paragraphs inside a block; of its lines where it has none."""
    piece = lambda s: F.slice(page["texts"], s["first"] + 1, s["stop"] - s["first"])
    inside = F.filter(page["spans"], lambda s: (s["pos"] > block["pos"]) & (s["pos"] <= block["last"]))
    marked = F.transform(inside, lambda s: clean_text(F.array_join(piece(s), " ")))
    lines = split_paragraphs(F.array_join(piece(block), "\n"))
    return F.when(block["worse"] < 0, F.when(F.size(marked) > 0, marked).otherwise(lines))


def main_content(nodes: DataFrame) -> DataFrame:
    """Paragraphs of the best block of each page, and its score; one grouped pass."""
    out = nodes.where("kind IN ('block', 'page')").groupBy("page_id").agg(_page_block().alias("b"), _page_texts().alias("t"))
    return out.where("b.worse < 0").select(
        "page_id", _block_paragraphs(F.col("b"), F.col("t")).alias("paragraphs"), (-F.col("b.worse")).alias("score")
    )


def _filled(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def article_fields(nodes: DataFrame) -> DataFrame:
    """title, author, date, summary, cover, content_text and paragraphs per page.

    The node table is read once: every rule is a conditional aggregate of one
    grouped pass, so a page is parsed once and its nodes are exchanged once,
    already reduced to a row per page.  A field takes structured data first,
    then the meta rules in order, then (titles only) the title tags.  ``page_id`` must be unique.
    """
    rules = {field: [tuple(key.split("=")) for key in keys] for field, keys in K.META_PRIORITY.items()}
    # only the first tag of a rule counts, also when its content is empty
    metas = {
        f"_{field}_{i}": F.min(F.when((F.col("kind") == "meta") & (_attr(name) == value), F.struct("pos", _attr("content").alias("value"))))
        for field, keys in rules.items() for i, (name, value) in enumerate(keys)
    }
    tag = F.min(F.when((F.col("kind") == "title") & (strip("text") != ""), F.struct("pos", strip("text").alias("value"))))
    page = nodes.groupBy("page_id").agg(
        F.min("url").alias("url"), _page_item().alias("_i"), _page_block().alias("_b"), _page_texts().alias("_t"), tag.alias("_tag"),
        *[m.alias(name) for name, m in metas.items()],
    )
    item = F.col("_i.item")
    j = lambda n: F.get_json_object(item, f"$['{n}']")
    structured = {
        "title": F.coalesce(F.nullif(j("headline"), F.lit("")), j("name")),
        "author": _names_of(j("author")),
        "date": F.coalesce(F.nullif(j("datePublished"), F.lit("")), j("dateModified")),
        "summary": j("description"),
        "cover": _text_of(j("image"), "url", "@id"),
    }
    chosen = {
        field: F.coalesce(_filled(value), *[_filled(F.col(f"_{field}_{i}.value")) for i in range(len(rules.get(field, ())))])
        for field, value in structured.items()
    }
    chosen["title"] = F.coalesce(chosen["title"], F.col("_tag.value"))
    own = split_paragraphs(F.nullif(j("articleBody"), F.lit("")))
    paragraphs = F.coalesce(
        F.when(F.size(own) > 0, own), _block_paragraphs(F.col("_b"), F.col("_t")), F.array().cast("array<string>")
    )
    out = page.select("page_id", "url", *[v.alias(f) for f, v in chosen.items()], paragraphs.alias("paragraphs"))
    return out.select(
        "page_id", "title", "author", "date",
        F.coalesce("summary", F.try_element_at("paragraphs", F.lit(1))).alias("summary"),
        F.when(F.col("cover").isNotNull(), normalize_url("url", "cover")).alias("cover"),
        F.when(F.size("paragraphs") > 0, F.array_join("paragraphs", "\n\n")).alias("content_text"), "paragraphs",
    )


def field_provenance(first: DataFrame, second: DataFrame, key: str, fields: list[str], threshold: float = 0.55) -> DataFrame:
    """Fill missing or unsure fields from a second source and say where each came from.

    ``first`` may carry ``confidence`` (map); results carry maps ``confidence``
    and ``source_map``.
    """
    has_conf = "confidence" in first.columns
    right = second.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    j = first.join(right, key, "left")
    blank = lambda c: c.isNull() | (strip(c) == "")
    values, conf, src = {}, [], []
    for f in fields:
        own, other = F.col(f), F.col(f"_{f}")
        unsure = F.coalesce(F.try_element_at("confidence", F.lit(f)) < threshold, F.lit(False)) if has_conf else F.lit(False)
        taken = (blank(own) | unsure) & ~blank(other)
        values[f] = F.when(taken, other).otherwise(own)
        conf += [F.lit(f), F.when(taken, 0.7).when(blank(own), 0.0).otherwise(0.6)]
        src += [F.lit(f), F.when(taken, "ai").when(blank(own), "missing").otherwise("rule")]
    return j.withColumns({"_c": F.create_map(*conf), "_s": F.create_map(*src), **{f"_v_{f}": v for f, v in values.items()}}).select(
        key, *[F.col(f"_v_{f}").alias(f) for f in fields], F.col("_c").alias("confidence"), F.col("_s").alias("source_map")
    )


# ---------------------------------------------------------------------------
# links, images, listings
# ---------------------------------------------------------------------------

def _first_rows(df: DataFrame, keys: list[str], order: list[Column | str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def extract_links(nodes: DataFrame) -> DataFrame:
    """Anchors of a page, those around an image first, each URL once."""
    links = nodes.where("kind = 'link'").where(F.coalesce(_attr("href") != "", F.lit(False)))
    has_image = F.exists(F.map_keys("attrs"), lambda k: k.startswith("img."))
    title = F.when(F.col("text") != "", F.col("text")).otherwise(clean_text(_attr("img.alt")))
    staged = links.select(
        "page_id", "pos", F.col("url").alias("base"), _attr("href").alias("href"), _attr("img.src").alias("src"),
        has_image.alias("with_image"), F.when(title != "", title).alias("title"),
    ).withColumns({
        "link": normalize_url("base", "href"),
        "cover_url": F.when(F.col("src") != "", normalize_url("base", "src")),
    })
    first = _first_rows(
        staged, ["page_id", "link"], [(~F.col("with_image")).cast("int").alias("o"), "pos"], ["with_image", "pos", "title", "cover_url"]
    )
    return first.select("page_id", infer_id_or_hash("link").alias("id"), "title", F.col("link").alias("url"), "cover_url", "with_image", "pos")


def srcset_last(value: Column) -> Column:
    entries = F.filter(F.transform(F.split(value, ","), lambda s: F.split(strip(s), " ")[0]), lambda s: s != "")
    return F.try_element_at(entries, F.lit(-1))


def extract_images(pages: DataFrame, nodes: DataFrame, base: Column | str = "url") -> DataFrame:
    """Image URLs of reader pages in order, each once: srcset, lazy attributes, script arrays."""
    srcset = F.coalesce(F.nullif(_attr("srcset"), F.lit("")), _attr("data-srcset"))
    found = F.array(srcset_last(srcset), *[_attr(a) for a in K.LAZY_ATTRS])
    tags = nodes.where("kind = 'image'").select(
        "page_id", "url", F.col("pos").cast("long").alias("pos"), F.posexplode(found).alias("sub", "ref")
    )
    arrays = [F.regexp_extract("html", p, 1) for p in K.SCRIPT_ARRAYS]
    parsed = [F.from_json(F.replace(a, F.lit("'"), F.lit('"')), "array<string>") for a in arrays]
    urls = F.coalesce(*[F.when((a != "") & (F.size(p) > 0), p) for a, p in zip(arrays, parsed)])
    scripts = pages.select("page_id", "url", F.lit(1 << 40).alias("pos"), F.posexplode(urls).alias("sub", "ref"))
    refs = tags.unionByName(scripts).where("ref <> ''")
    full = refs.withColumn("image", normalize_url(base, "ref")).where(
        "image <> '' AND NOT startswith(image, 'data:') AND NOT startswith(image, 'about:')"
    )
    return _first_rows(full, ["page_id", "image"], ["pos", "sub"], ["pos", "sub"])


def _within(*marks: str) -> Column:
    """The element matches, or stands inside, one of the tag/class marks."""
    return any_of([F.array_contains("around", m) for m in marks])


CHAPTER_MARKS = ("li.wp-manga-chapter", ".listing-chapters_wrap")


def extract_chapters(nodes: DataFrame, marks: tuple[str, ...] = CHAPTER_MARKS) -> DataFrame:
    """Chapter links of a series page: id, title, url, place."""
    links = nodes.where((F.col("kind") == "link") & _within(*marks)).where(F.coalesce(_attr("href") != "", F.lit(False)))
    staged = links.select("page_id", "pos", "text", normalize_url("url", _attr("href")).alias("link"))
    return staged.select(
        "page_id", infer_id_or_host("link").alias("id"), "pos", F.col("link").alias("url"),
        F.when(F.col("text") != "", F.col("text")).otherwise(infer_id_or_host("link")).alias("title"),
    )


def extract_cards(nodes: DataFrame) -> DataFrame:
    """Series cards of a listing page, each URL once."""
    links = nodes.where("kind = 'link'").where(F.coalesce(_attr("href") != "", F.lit(False)))
    cover = F.coalesce(*[
        F.when(
            (strip(v) != "") & ~v.startswith("data:") & ~v.startswith("about:"),
            srcset_last(v) if a.endswith("srcset") else strip(v),
        )
        for a, v in ((a, _attr(f"img.{a}")) for a in K.COVER_ATTRS)
    ])
    title = F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in (F.col("text"), _attr("title"), _attr("aria-label"), _attr("img.alt"))])
    staged = links.select(
        "page_id", "pos", title.alias("title"), F.col("url").alias("base"), cover.alias("cover"),
        normalize_url("url", _attr("href")).alias("link"),
    ).where(is_content_url("link"))
    first = _first_rows(staged, ["page_id", "link"], ["pos"], ["pos", "title", "base", "cover"])
    return first.select(
        "page_id", "pos", infer_id_or_host("link").alias("id"), F.coalesce("title", infer_id_or_host("link")).alias("title"),
        F.col("link").alias("url"), F.when(F.col("cover").isNotNull(), normalize_url("base", "cover")).alias("cover_url"),
    )


def page_kind(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per page: is it a series page, has it a next page, is it a challenge?"""
    detail = (F.col("kind") == "link") & _within(*CHAPTER_MARKS)
    rel_next = F.col("kind").isin("link", "rel") & F.array_contains(F.split(F.coalesce(_attr("rel"), F.lit("")), " "), "next")
    own_next = F.array_contains("around", "self:.next") & (
        F.array_contains("around", "self:a.page-numbers")
        | (F.array_contains("around", "self:a") & _within(".nav-links", ".pagination"))
    )
    below = F.col("tag").eqNullSafe("a") & (
        F.array_contains("around", ".nav-next") | (F.array_contains("around", ".page-numbers") & F.array_contains("around", ".next"))
    )
    flags = nodes.groupBy("page_id").agg(
        F.bool_or(detail).alias("is_detail"), F.bool_or(rel_next | own_next | below).alias("has_next")
    )
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return pages.select("page_id", looks_like_challenge("html").alias("is_challenge")).join(flags, "page_id", "left").select(
        "page_id", no("is_detail"), no("has_next"), "is_challenge"
    )


def page_title(nodes: DataFrame) -> DataFrame:
    """Series title: heading class, first heading, then meta titles."""
    element = F.col("kind") == "element"
    rules = [
        (element & F.array_contains("around", "self:.post-title"), F.col("text")),
        (element & (F.col("tag") == "h1"), F.col("text")),
        ((F.col("kind") == "meta") & (_attr("property") == "og:title"), _attr("content")),
        ((F.col("kind") == "meta") & (_attr("name") == "title"), _attr("content")),
    ]
    hits = F.array_compact(F.array(*[
        F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("rule"), strip(v).alias("value"))) for i, (c, v) in enumerate(rules)
    ]))
    rows = nodes.select("page_id", "pos", F.explode(hits).alias("h"))
    # the first node of each rule decides; the first rule with a text wins
    first = rows.groupBy("page_id", "h.rule").agg(F.min(F.struct("pos", "h.value")).alias("m"))
    return first.where("m.value <> ''").groupBy("page_id").agg(F.min_by("m.value", "rule").alias("title"))
