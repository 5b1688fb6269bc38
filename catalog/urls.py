"""URL, name and HTML-text functions over the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from pageloom.functions import urls

PATH = r"regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '^[A-Za-z][-A-Za-z0-9+.]*:', ''), '^//[^/?#]*', ''), '^([^?#]*)', 1), ';[^/]*$', '')"
NETLOC = r"regexp_extract(url, '^(?:[A-Za-z][-A-Za-z0-9+.]*:)?//([^/?#]*)', 1)"
HOST = f"lower(regexp_replace(regexp_replace({NETLOC}, '^.*@', ''), ':[0-9]*$', ''))"
SEG = f"list_extract(string_split(regexp_replace({PATH}, '/+$', ''), '/'), -1)"
# urls of the corpus in several shapes: as found, below a series, a listing
VARIED = """WITH varied AS (SELECT page_id, CASE page_id % 8
    WHEN 0 THEN url WHEN 1 THEN 'https://www.toongod.org/webtoon/s' || page_id || '/'
    WHEN 2 THEN 'https://mangaforfree.com/manga/page/' || page_id || '/?m_orderby=latest'
    WHEN 3 THEN 'https://mangaforfree.com/manga/s' || page_id || '/chapter-2/'
    WHEN 4 THEN 'https://i0.wp.com/toongod.org/wp-content/' || page_id || '.PNG?w=9'
    WHEN 5 THEN 'https://user:pw@cdn.toongod.org:8443/a/b' || page_id || '.webp;v=1#x'
    WHEN 6 THEN 'id-' || page_id ELSE 'http://h' || page_id || '.example.org' END AS url FROM pages)
"""


def varied(t):
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 8
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    url = (
        F.when(m == 0, F.col("url"))
        .when(m == 1, c("https://www.toongod.org/webtoon/s", i, "/"))
        .when(m == 2, c("https://mangaforfree.com/manga/page/", i, "/?m_orderby=latest"))
        .when(m == 3, c("https://mangaforfree.com/manga/s", i, "/chapter-2/"))
        .when(m == 4, c("https://i0.wp.com/toongod.org/wp-content/", i, ".PNG?w=9"))
        .when(m == 5, c("https://user:pw@cdn.toongod.org:8443/a/b", i, ".webp;v=1#x"))
        .when(m == 6, c("id-", i))
        .otherwise(c("http://h", i, ".example.org"))
    )
    return t.pages.select("page_id", url.alias("url"))


def _over_urls(name: str, sql: str, make) -> None:
    @query(name, VARIED + f"SELECT page_id, {sql} AS value FROM varied")
    def run(t):
        return varied(t).select("page_id", make(F.col("url")).alias("value"))


_over_urls("infer_id", f"CASE WHEN regexp_matches(url, '^https?://') THEN {SEG} ELSE url END", urls.infer_id)
_over_urls("infer_id_or_hash", f"CASE WHEN {SEG} <> '' THEN {SEG} ELSE substr(sha1(url), 1, 12) END", urls.infer_id_or_hash)
_over_urls("infer_id_or_host", f"CASE WHEN {SEG} <> '' THEN {SEG} WHEN {HOST} <> '' THEN {HOST} ELSE url END", urls.infer_id_or_host)
_over_urls(
    "normalize_base_url",
    f"CASE WHEN regexp_matches(url, '^[A-Za-z][-A-Za-z0-9+.]*://[^/?#]') THEN lower(split_part(url, ':', 1)) || '://' || {NETLOC} ELSE regexp_replace(url, '/+$', '') END",
    urls.normalize_base_url,
)
_over_urls(
    "recognize_site",
    f"CASE regexp_replace({HOST}, '^www[.]', '') WHEN 'toongod.org' THEN 'toongod' WHEN 'mangaforfree.com' THEN 'mangaforfree' END",
    urls.recognize_site,
)
_over_urls(
    "is_content_url",
    f"""(SELECT p <> '' AND NOT contains(p, '/chapter') AND NOT contains(p, 'chapter-')
       AND NOT starts_with(p, 'manga-genre') AND NOT starts_with(p, 'webtoon-genre')
       AND CASE WHEN list_contains(string_split(p, '/'), 'manga')
           THEN coalesce(list_extract(string_split(p, '/'), list_position(string_split(p, '/'), 'manga') + 1) NOT IN ('page','genre','category','tag'), false)
         WHEN list_contains(string_split(p, '/'), 'webtoon')
           THEN coalesce(list_extract(string_split(p, '/'), list_position(string_split(p, '/'), 'webtoon') + 1) NOT IN ('page','genre','category','tag'), false)
         ELSE false END FROM (SELECT trim(lower({PATH}), '/') AS p))""",
    urls.is_content_url,
)
_over_urls(
    "host_allowed",
    f"""({HOST} IN ('toongod.org', 'mangaforfree.com') OR ends_with({HOST}, '.toongod.org') OR ends_with({HOST}, '.mangaforfree.com')
      OR (({HOST} = 'wp.com' OR ends_with({HOST}, '.wp.com')) AND (contains(lower({PATH}), '/toongod.org/') OR contains(lower({PATH}), '/mangaforfree.com/'))))""",
    lambda c: urls.host_allowed(c, ["toongod.org", "mangaforfree.com"]),
)
_over_urls(
    "cookie_domain_matches",
    f"({HOST} <> '' AND ({HOST} = 'toongod.org' OR ends_with({HOST}, '.toongod.org')))",
    lambda c: urls.cookie_domain_matches(F.lit(".TOONGOD.org"), urls.url_host(c)),
)
_over_urls(
    "cover_key",
    f"""sha256(url) || CASE WHEN lower(regexp_extract(list_extract(string_split({PATH}, '/'), -1), '[^.]([.][^.]+)$', 1)) IN ('.jpg','.jpeg','.png','.webp')
      THEN lower(regexp_extract(list_extract(string_split({PATH}, '/'), -1), '[^.]([.][^.]+)$', 1)) ELSE '.jpg' END""",
    urls.cover_key,
)


@query("infer_url", VARIED + """SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN url
   WHEN page_id % 3 = 0 THEN 'https://mangaforfree.com/manga/' || url
   WHEN page_id % 3 = 1 THEN 'https://x.org/webtoon/s1/' || url || '/' END AS value FROM varied""")
def _(t):
    m = F.col("page_id") % 3
    base = F.when(m == 0, "https://mangaforfree.com/").otherwise("https://x.org")
    kind = F.when(m == 0, "manga").when(m == 1, "chapter").otherwise("volume")
    return varied(t).select("page_id", urls.infer_url(base, "url", kind, F.lit("s1")).alias("value"))


@query("normalize_url", VARIED + f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://cdn.example.org/' || page_id
   WHEN 1 THEN 'https://toongod.org/p/' || page_id ELSE 'https://toongod.org/a/' || page_id || '.html' END AS value FROM varied""")
def _(t):
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 3
    ref = (
        F.when(m == 0, F.concat(F.lit("//cdn.example.org/"), i)).when(m == 1, F.concat(F.lit("/p/"), i))
        .otherwise(F.concat(F.lit("../a/"), i, F.lit(".html")))
    )
    return t.pages.select("page_id", urls.normalize_url(F.lit("https://toongod.org/b/c"), ref).alias("value"))


WORD = r"[^\p{L}\p{N}_\s\x{85}\p{Z}-]"


@query("slugify", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(regexp_replace(text,
   '^[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]+|[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]+\z', '', 'g')), '_', ' '),
   '[^\p{L}\p{N}_\s\x{85}\p{Z}-]', '', 'g'), '[\s\x{85}\p{Z}-]+', '-', 'g'), '^-+', ''), '-+$', '') AS slug,
   CASE WHEN trim(regexp_replace(text, '[^\p{L}\p{N}_-]+', '_', 'g'), '_') = '' THEN 'manga'
     ELSE trim(regexp_replace(text, '[^\p{L}\p{N}_-]+', '_', 'g'), '_') END AS name FROM documents""")
def _(t):
    return t.documents.select("doc_id", urls.slugify("text").alias("slug"), urls.safe_name("text").alias("name"))


@query("parse_range", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 3 WHEN 1 THEN least(page_id, 7) END AS first,
   CASE page_id % 4 WHEN 0 THEN page_id + 3 WHEN 1 THEN greatest(page_id, 7) END AS last,
   CASE page_id % 4 WHEN 2 THEN 'not_positive' WHEN 3 THEN 'bad_format' END AS reason FROM pages""")
def _(t):
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 4
    text = (
        F.when(m == 0, F.concat((F.col("page_id") + 3).cast("string"), F.lit("-3 ")))
        .when(m == 1, F.concat(F.lit(" "), i, F.lit(" : 7"))).when(m == 2, F.concat(F.lit("0-"), i))
        .otherwise(F.concat(i, F.lit("..9")))
    )
    return t.pages.select("page_id", urls.parse_range(text).alias("r")).select("page_id", "r.*").select(
        "page_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "reason"
    )


@query("parse_catalog_url", VARIED + f"""SELECT page_id,
   CASE page_id % 8 WHEN 2 THEN '/manga/' WHEN 6 THEN '/' || url WHEN 7 THEN '/' ELSE {PATH} END AS path,
   CASE page_id % 8 WHEN 2 THEN page_id ELSE 1 END AS page,
   CASE page_id % 8 WHEN 2 THEN 'latest' END AS orderby FROM varied""")
def _(t):
    return varied(t).select("page_id", urls.parse_catalog_url("url").alias("c")).select("page_id", "c.*")


_over_urls(
    "normalize_catalog_path",
    f"CASE page_id % 8 WHEN 6 THEN '/' || url WHEN 7 THEN '/' ELSE {PATH} END",
    urls.normalize_catalog_path,
)


@query("looks_like_challenge", """SELECT page_id, contains(h, 'cf-browser-verification') OR contains(h, 'challenge-platform')
   OR contains(h, 'cloudflare ray id') OR contains(h, 'attention required') OR contains(h, 'just a moment') AS value
   FROM (SELECT page_id, lower(html) || CASE page_id % 6 WHEN 0 THEN 'just a moment' ELSE '' END AS h FROM pages)""")
def _(t):
    html = F.concat("html", F.when(F.col("page_id") % 6 == 0, "Just A Moment").otherwise(""))
    return t.pages.select("page_id", urls.looks_like_challenge(html).alias("value"))


@query("http_outcome", """SELECT event_id, CASE WHEN code = 403 THEN 'forbidden' WHEN code >= 400 THEN 'error' ELSE 'ok' END AS outcome
   FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 403 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 301 ELSE 500 END AS code FROM events)""")
def _(t):
    e = F.col("event_type")
    code = F.when(e == "click", 200).when(e == "view", 403).when(e == "signup", 404).when(e == "purchase", 301).otherwise(500)
    return t.events.select("event_id", urls.http_outcome(code).alias("outcome"))


@query("public_url", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/data/raw/s/' || page_id || '.jpg?v=' || page_id * 7
   ELSE '/data/s/' || page_id || '.jpg' END AS url FROM pages""")
def _(t):
    even = F.col("page_id") % 2 == 0
    root = F.when(even, "/srv/data/raw/").otherwise("/srv/data")
    path = F.concat(F.regexp_replace(root, "/$", ""), F.lit("/s/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    return t.pages.select("page_id", urls.public_url(path, root, F.when(even, F.col("page_id") * 7)).alias("url"))
