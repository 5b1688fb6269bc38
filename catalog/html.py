"""Extraction queries over the page corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import query
from pageloom.operators import html as H
from pageloom.sources.html import extract_nodes

LINKS = """WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS txt FROM pages),
 l AS (SELECT page_id, href, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS link, txt FROM a)
"""


@query("extract_nodes", LINKS + """, t AS (SELECT page_id, count(*) AS links FROM a GROUP BY 1)
 SELECT page_id, 'link' AS kind, links AS n FROM t UNION ALL SELECT page_id, 'title', 1 FROM pages""")
def _(t):
    nodes = extract_nodes(t.spread("pages")).where("kind IN ('link', 'title')")
    return nodes.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("extract_links", LINKS + """SELECT DISTINCT page_id, link AS url FROM l""")
def _(t):
    return H.extract_links(extract_nodes(t.spread("pages"))).select("page_id", "url")


def unescaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"


def squeezed(x: str) -> str:
    return S.strip(f"regexp_replace({x}, '{S.WS}+', ' ', 'g')")


# The best block of the given pages is their article or the advertisement before it.  A paragraph
# that is never closed reaches to the end of the article and holds all of those after it.
ARTICLES = f"""WITH p AS (SELECT page_id, {unescaped("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
   {unescaped("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} AS ad,
   regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS art FROM pages),
 s AS (SELECT page_id, unnest(regexp_split_to_array(art, '<p>')) AS seg, generate_subscripts(regexp_split_to_array(art, '<p>'), 1) AS i FROM p),
 x AS (SELECT page_id, i, contains(seg, '</p>') AS closed, {unescaped("regexp_replace(seg, '<[^>]*>', ' ', 'g')")} AS txt FROM s),
 q AS (SELECT page_id, i, txt, {squeezed("CASE WHEN closed THEN txt ELSE rest END")} AS par FROM (
   SELECT *, string_agg(txt, ' ') OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM x)),
 a AS (SELECT page_id, {squeezed("string_agg(txt, ' ' ORDER BY i)")} AS body, count(*) FILTER (i > 1 AND par <> '') AS n,
   list(par ORDER BY i) FILTER (i > 1 AND par <> '') AS pars FROM q GROUP BY 1),
 m AS (SELECT page_id, {squeezed('title')} AS title, {S.strip('ad')} AS ad, length({squeezed('ad')}) AS ad_score, length(body) + 25 * n AS art_score,
   CASE WHEN n > 0 THEN pars ELSE [body] END AS pars FROM a JOIN p USING (page_id)),
 c AS (SELECT page_id, title, greatest(ad_score, art_score)::INT AS score, CASE WHEN ad_score >= art_score THEN [ad] ELSE pars END AS pars FROM m)
"""


@query("article_fields", ARTICLES + """SELECT page_id, nullif(title, '') AS title, NULL::VARCHAR AS author, NULL::VARCHAR AS date, NULL::VARCHAR AS cover,
   CASE WHEN score > 0 THEN pars[1] END AS summary, CASE WHEN score > 0 THEN array_to_string(pars, chr(10) || chr(10)) END AS content_text,
   CASE WHEN score > 0 THEN len(pars) ELSE 0 END::INT AS paragraphs FROM c""")
def _(t):
    out = H.article_fields(extract_nodes(t.spread("pages")))
    return out.withColumn("paragraphs", F.size("paragraphs"))


@query("article_titles", f"""SELECT page_id, {S.strip("regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '" + S.WS + "+', ' ', 'g')")} AS title FROM pages""")
def _(t):
    return H.article_fields(extract_nodes(t.spread("pages"))).select("page_id", "title")


@query("main_content", ARTICLES + """SELECT page_id, score, array_to_string(pars, chr(10) || chr(10)) AS content FROM c WHERE score > 0""")
def _(t):
    return H.main_content(extract_nodes(t.spread("pages"))).select("page_id", "score", F.array_join("paragraphs", "\n\n").alias("content"))


# the same documents as structured data: list, graph and single items
def structured(t):
    body = F.to_json(F.struct(F.col("text").alias("articleBody"), F.lit("Article").alias("@type"), F.concat(F.lit("Doc "), F.col("doc_id")).alias("headline")))
    thin = F.to_json(F.struct(F.lit("Organization").alias("@type"), F.col("source").alias("name")))
    m = F.col("doc_id") % 3
    raw = (
        F.when(m == 0, F.concat(F.lit("["), thin, F.lit(","), body, F.lit("]")))
        .when(m == 1, F.concat(F.lit('{"@graph":['), body, F.lit(","), thin, F.lit("]}"))).otherwise(thin)
    )
    return t.documents.select(
        F.col("doc_id").alias("page_id"), F.lit("https://x.org/").alias("url"),
        F.concat(F.lit('<html><head><script type="application/ld+json">'), F.replace(raw, F.lit("</"), F.lit("<\\/")), F.lit("</script></head></html>")).alias("html"),
    )


@query("pick_jsonld", """SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 2 THEN source ELSE 'Doc ' || doc_id END AS title, CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 9 END AS score FROM documents""")
def _(t):
    best = H.pick_jsonld(extract_nodes(structured(t)))
    return best.select("page_id", F.coalesce(F.get_json_object("item", "$.headline"), F.get_json_object("item", "$.name")).alias("title"), "score")


@query("split_paragraphs", f"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n{{2,}}')) AS part, generate_subscripts(regexp_split_to_array(text, '\n{{2,}}'), 1) AS i FROM documents)
 SELECT doc_id, string_agg({S.strip('part')}, '|' ORDER BY i) FILTER ({S.strip('part')} <> '') AS parts, count(*) FILTER ({S.strip('part')} <> '')::INT AS n FROM p GROUP BY 1""")
def _(t):
    parts = t.documents.select("doc_id", H.split_paragraphs("text").alias("p"))
    return parts.select("doc_id", F.array_join("p", "|").alias("parts"), F.size("p").alias("n"))


# reader pages built from the links of each page: lazy images, srcset, script arrays
def readers(t):
    # commas separate srcset entries, so the built pages have none inside a name
    words = F.transform(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1), lambda w: F.replace(w, F.lit(","), F.lit("")))
    image = F.transform(words, lambda w, i: F.when(i % 3 == 0, F.concat(F.lit('<img data-src="'), w, F.lit('.png">'))).when(
        i % 3 == 1, F.concat(F.lit('<img srcset="/small'), w, F.lit('.png 1x, /big'), w, F.lit('.png 2x" src="data:x">'))
    ).otherwise(F.concat(F.lit('<img src="'), w, F.lit('.png">'))))
    script = F.concat(F.lit("<script>var chapter_images = ['/one.jpg', '/two"), F.col("page_id").cast("string"), F.lit(".jpg'];</script>"))
    return t.pages.select("page_id", F.lit("https://x.org/r/").alias("url"), F.concat(F.array_join(image, ""), script).alias("html"))


@query("extract_images", """WITH a AS (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: replace(x, ',', '')) AS w FROM pages),
 i AS (SELECT page_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM a)
 SELECT DISTINCT page_id, 'https://x.org' || CASE (i-1) % 3 WHEN 1 THEN '/big' || w ELSE w END || '.png' AS image FROM i
 UNION ALL SELECT page_id, 'https://x.org/one.jpg' FROM pages UNION ALL SELECT page_id, 'https://x.org/two' || page_id || '.jpg' FROM pages""")
def _(t):
    pages = readers(t)
    return H.extract_images(pages, extract_nodes(pages)).select("page_id", "image")


# listing pages built from the same links: chapters, cards, a next link on some
def listings(t):
    words = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), 1)
    rows = F.transform(words, lambda w, i: F.when(i % 2 == 0, F.concat(F.lit('<li class="wp-manga-chapter"><a href="/manga/s/chapter-'), i.cast("string"), F.lit('/">'), w, F.lit("</a></li>"))).otherwise(
        F.concat(F.lit('<div class="page-item-detail"><a href="/manga/'), w, F.lit('/" title="T"><img src="/c.png"></a></div>'))
    ))
    head = F.when(F.col("page_id") % 2 == 0, '<h1> Head <b>Line</b></h1><a class="next page-numbers" href="/p/2">next</a>').otherwise('<div class="post-title">Post</div><h1>H</h1>')
    return t.pages.select("page_id", F.lit("https://x.org/").alias("url"), F.concat(head, F.array_join(rows, "")).alias("html"))


BUILT = """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS w FROM pages),
 i AS (SELECT page_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM a)
"""


@query("extract_chapters", BUILT + """SELECT page_id, 'chapter-' || i AS id, w AS title, 'https://x.org/manga/s/chapter-' || i || '/' AS url FROM i WHERE i % 2 = 0""")
def _(t):
    return H.extract_chapters(extract_nodes(listings(t))).select("page_id", "id", "title", "url")


@query("extract_cards", BUILT + """SELECT DISTINCT page_id, 'https://x.org/manga/' || w || '/' AS url, 'https://x.org/c.png' AS cover_url, 'T' AS title FROM i WHERE i % 2 = 1 AND w NOT IN ('page', 'genre', 'category', 'tag', '')""")
def _(t):
    return H.extract_cards(extract_nodes(listings(t))).select("page_id", "url", "cover_url", "title")


@query("page_kind", """SELECT page_id, len(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) > 0 AS is_detail, page_id % 2 = 0 AS has_next, false AS is_challenge FROM pages""")
def _(t):
    pages = listings(t)
    return H.page_kind(pages, extract_nodes(pages))


@query("page_title", """SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'Head Line' ELSE 'Post' END AS title FROM pages""")
def _(t):
    return H.page_title(extract_nodes(listings(t)))


@query("field_provenance", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'second' ELSE source END AS title, lang AS author, CASE WHEN doc_id % 3 = 0 THEN 0.7 ELSE 0.6 END::DOUBLE AS title_conf,
   CASE WHEN doc_id % 3 = 0 THEN 'ai' ELSE 'rule' END AS title_source, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'rule' END AS date_source FROM documents""")
def _(t):
    d = F.col("doc_id")
    first = t.documents.select(
        "doc_id", F.when(d % 6 == 0, " ").otherwise(F.col("source")).alias("title"), F.col("lang").alias("author"),
        F.when(d % 5 != 0, "2024-01-01").alias("date"), F.create_map(F.lit("title"), F.when(d % 6 == 3, 0.5).otherwise(0.6)).alias("confidence"),
    )
    second = t.documents.select("doc_id", F.lit("second").alias("title"), F.lit("x").alias("author"), F.lit(None).cast("string").alias("date"))
    out = H.field_provenance(first, second, "doc_id", ["title", "author", "date"])
    return out.select(
        "doc_id", "title", "author", F.col("confidence")["title"].cast("double").alias("title_conf"),
        F.col("source_map")["title"].alias("title_source"), F.col("source_map")["date"].alias("date_source"),
    )
