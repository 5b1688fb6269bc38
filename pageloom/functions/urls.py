"""URL and file-name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.constants import CHALLENGE_MARKERS, IMAGE_EXTENSIONS, PARAMETER_SCHEMES, RELATIVE_SCHEMES, SITE_HOSTS
from pageloom.functions.base import ColumnLike, any_of, col, let, literal_map, strip

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def url_scheme(url: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_netloc(url: ColumnLike) -> Column:
    return F.regexp_extract(col(url), _AUTHORITY, 1)


def url_host(url: ColumnLike) -> Column:
    """Host name in lower case, without user and port."""
    bare = F.regexp_replace(url_netloc(url), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*\z", ""))


def url_path(url: ColumnLike) -> Column:
    """Path without query, fragment and parameters of the last segment."""
    rest = F.regexp_replace(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    rest = F.regexp_replace(rest, r"^//[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*\z", "")


def _last_segment(url: ColumnLike) -> Column:
    path = F.regexp_replace(url_path(url), r"/+\z", "")
    return F.element_at(F.split(path, "/"), -1)


def infer_id(url: ColumnLike) -> Column:
    """Last path segment of a URL; other values are ids already."""
    u = col(url)
    return F.when(u.rlike("^https?://"), _last_segment(u)).otherwise(u)


def infer_id_or_hash(url: ColumnLike) -> Column:
    seg = _last_segment(url)
    return F.when(seg != "", seg).otherwise(F.substring(F.sha1(col(url)), 1, 12))


def infer_id_or_host(url: ColumnLike) -> Column:
    seg, host = _last_segment(url), url_host(url)
    return F.when(seg != "", seg).when(host != "", host).otherwise(col(url))


def infer_url(base: ColumnLike, value: ColumnLike, kind: ColumnLike, parent: ColumnLike) -> Column:
    """URL of a series or chapter id; null when it cannot be built."""
    b, v = col(base), col(value)
    root = F.regexp_replace(b, r"/+\z", "")
    folder = F.when(b.contains("mangaforfree.com"), "manga").otherwise("webtoon")
    has_parent = F.coalesce(col(parent) != "", F.lit(False))
    return (
        F.when(v.rlike("^https?://"), v)
        .when(col(kind) == "manga", F.concat_ws("/", root, folder, v))
        .when(
            (col(kind) == "chapter") & has_parent,
            F.concat(F.concat_ws("/", root, folder, col(parent), v), F.lit("/")),
        )
    )


def normalize_base_url(url: ColumnLike) -> Column:
    u = col(url)
    scheme, netloc = url_scheme(u), url_netloc(u)
    return F.when(
        (scheme != "") & (netloc != ""), F.concat(scheme, F.lit("://"), netloc)
    ).otherwise(F.regexp_replace(u, r"/+\z", ""))


def _parts(url: Column) -> Column:
    """Scheme, authority, path, query and fragment of a reference (RFC 3986, appendix B)."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x{00}-\x{20}]+", ""), r"[\t\r\n]", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    tail = F.regexp_replace(rest, r"^//[^/?#]*", "")
    return F.struct(
        url_scheme(bare).alias("scheme"), F.regexp_extract(rest, r"^//([^/?#]*)", 1).alias("host"),
        F.regexp_extract(tail, r"^([^?#]*)", 1).alias("path"), F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        F.regexp_extract(tail, r"(?s)^[^#]*#(.*)\z", 1).alias("fragment"),
    )


def _with_parameters(path: Column, scheme: Column) -> Column:
    """Struct (path, params): what follows a semicolon in the last segment stands apart."""
    params = F.when(scheme.isin(*PARAMETER_SCHEMES), F.regexp_extract(path, r"(;[^/]*)\z", 1)).otherwise("")
    return let(params, lambda p: F.struct(
        F.substr(path, F.lit(1), F.length(path) - F.length(p)).alias("path"), F.when(p != ";", p).otherwise("").alias("params")
    ))


def _filled(segments: Column) -> Column:
    """Segments without empty ones between the first and the last."""
    return let(segments, lambda all_: F.filter(all_, lambda s, i: (s != "") | (i == 0) | (i == F.size(all_) - 1)))


def _without_dots(segments: Column) -> Column:
    """Path of the segments, with . and .. carried out."""
    dots = (".", "..")
    back = lambda kept, s: (
        F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    )
    walked = lambda part: F.concat(
        F.aggregate(part, F.array().cast("array<string>"), back),
        F.when(F.element_at(part, -1).isin(*dots), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
    )
    path = let(segments, lambda part: F.array_join(F.when(F.exists(part, lambda s: s.isin(*dots)), walked(part)).otherwise(part), "/"))
    return F.when(path == "", "/").otherwise(path)


def _recomposed(scheme: Column, host: Column, path: Column, query: Column, fragment: Column) -> Column:
    slash = path.startswith("/")
    body = (
        F.when(host != "", F.concat(F.lit("//"), host, F.when((path != "") & ~slash, "/").otherwise(""), path))
        .when(path.startswith("//") | ((scheme != "") & ((path == "") | slash)), F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    some = lambda before, x, after: F.when(x != "", F.concat(F.lit(before), x, F.lit(after))).otherwise("")
    return F.concat(some("", scheme, ":"), body, some("?", query, ""), some("#", fragment, ""))


def _joined(base: Column, url: Column) -> Column:
    """The reference ``url`` seen from ``base``; schemes that know no relative references leave it as it is."""
    def resolve(b: Column, u: Column) -> Column:
        scheme = F.when(u["scheme"] != "", u["scheme"]).otherwise(b["scheme"])
        own, outer = _with_parameters(u["path"], scheme), _with_parameters(b["path"], b["scheme"])
        return let(F.struct(scheme.alias("scheme"), own.alias("own"), outer.alias("outer")), lambda x: merged(b, u, x))

    def merged(b: Column, u: Column, x: Column) -> Column:
        own, outer = x["own"], x["outer"]
        whole = lambda p: F.concat(p["path"], p["params"])
        segments = F.split(own["path"], "/")
        # the base gives its folders: all segments but the last, unless that is empty
        folders = F.split(F.regexp_replace(outer["path"], "[^/]+\\z", ""), "/")
        folders = F.when(outer["path"].rlike("^[^/]+\\z"), F.array().cast("array<string>")).when(
            outer["path"].rlike("[^/]\\z"), F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
        ).otherwise(folders)
        around = F.when(own["path"].startswith("/"), segments).otherwise(_filled(F.concat(folders, segments)))
        empty = whole(own) == ""
        path = F.when(u["host"] != "", whole(own)).when(empty, whole(outer)).otherwise(F.concat(_without_dots(around), own["params"]))
        query = F.when((u["host"] == "") & empty & (u["query"] == ""), b["query"]).otherwise(u["query"])
        host = F.when(u["host"] != "", u["host"]).otherwise(b["host"])
        broken = any_of([p["host"].contains("[") != p["host"].contains("]") for p in (b, u)])
        foreign = (x["scheme"] != b["scheme"]) | ~x["scheme"].isin(*RELATIVE_SCHEMES)
        return F.when(broken | foreign, url).otherwise(_recomposed(x["scheme"], host, path, query, u["fragment"]))

    parts = let(_parts(base), lambda b: let(_parts(url), lambda u: resolve(b, u)))
    return F.when(F.coalesce(base, F.lit("")) == "", url).when(url == "", base).otherwise(parts)


# a path without parameters, then a query and a fragment that are not empty; no blanks or controls
_PLAIN_TAIL = r"[^?#;\x{00}-\x{20}]*(?:\?[^#;\x{00}-\x{20}]+)?(?:#[^;\x{00}-\x{20}]+)?\z"
_ORIGIN = r"https?://[^/?#;\[\]\x{00}-\x{20}]+"

_NAME = r"[^/?#;:.\x{00}-\x{20}][^/?#;:\x{00}-\x{20}]*"
_BELOW = rf"^{_NAME}(?:/{_NAME})*/?(?:\?[^#;\x{{00}}-\x{{20}}]+)?(?:#[^;\x{{00}}-\x{{20}}]+)?\z"
_FOLDER = rf"^({_ORIGIN}/(?:{_NAME}/)*)(?:{_NAME})?(?:[?#]|\z)"


def normalize_url(base: ColumnLike, url: ColumnLike) -> Column:
    """Absolute URL; protocol-relative ones get https, the rest RFC 3986 joining.

    All in columns.  Whole URLs and plain paths, which are most, take a few
    patterns; only others are taken apart and folded.  Null stays null, without a
    base the URL stays as it is, and so does one whose host has half a pair of
    brackets; addresses in brackets are not looked into.
    """
    u, b = col(url), F.coalesce(col(base), F.lit(""))
    origin = F.regexp_extract(b, f"^({_ORIGIN})", 1)
    folder = F.regexp_extract(b, _FOLDER, 1)
    rooted = u.startswith("/") & ~u.contains("/.") & u.rlike(f"^/{_PLAIN_TAIL}") & (origin != "")
    return (
        F.when(u.startswith("//"), F.concat(F.lit("https:"), u))
        .when(u.rlike(f"^{_ORIGIN}(?:\\z|(?=[/?#]){_PLAIN_TAIL})"), u)
        .when(rooted, F.concat(origin, u))
        .when(u.rlike(_BELOW) & (folder != ""), F.concat(folder, u))
        .otherwise(_joined(b, u))
    )


def slugify(text: ColumnLike) -> Column:
    t = F.replace(F.lower(strip(col(text))), F.lit("_"), F.lit(" "))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s\x{85}\p{Z}\-]", "")
    t = F.regexp_replace(t, r"[\s\x{85}\p{Z}\-]+", "-")
    return F.regexp_replace(F.regexp_replace(t, "^-+", ""), r"-+\z", "")


def safe_name(text: ColumnLike, default: str = "manga") -> Column:
    t = F.regexp_replace(col(text), r"[^\p{L}\p{N}_\-]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, "^_+", ""), r"_+\z", "")
    return F.when(t == "", F.lit(default)).otherwise(t)


def parse_range(text: ColumnLike) -> Column:
    """Struct (first, last, reason); first and last are null for a bad range."""
    pattern = r"^\s*(\d+)\s*[-:]\s*(\d+)\s*\z"
    t = col(text)
    a = F.regexp_extract(t, pattern, 1).try_cast("long")
    b = F.regexp_extract(t, pattern, 2).try_cast("long")
    reason = (
        F.when(~t.rlike(pattern), "bad_format").when((a <= 0) | (b <= 0), "not_positive")
    )
    good = reason.isNull()
    return F.struct(
        F.when(good, F.least(a, b)).alias("first"),
        F.when(good, F.greatest(a, b)).alias("last"),
        reason.alias("reason"),
    )


def recognize_site(url: ColumnLike) -> Column:
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    return F.try_element_at(literal_map(SITE_HOSTS), host)


def parse_catalog_url(url: ColumnLike) -> Column:
    """Struct (path, page, orderby) of a paged listing URL."""
    path = F.when(url_path(url) == "", "/").otherwise(url_path(url))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    at = F.array_position(segments, F.lit("page")).cast("int")
    paged = (at > 0) & (at < F.size(segments))
    value = F.try_element_at(segments, F.when(paged, at + 1).otherwise(F.lit(1)))
    head = F.concat(F.lit("/"), F.concat_ws("/", F.slice(segments, F.lit(1), F.greatest(at - 1, F.lit(0)))), F.lit("/"))
    # the path is cut also where the page value is not a number
    usable = paged & value.rlike(r"^[+-]?\d+\z")
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    query = F.regexp_extract(col(url), r"^[^?#]*\?([^#]*)", 1)
    orderby = F.regexp_extract(query, r"(?:^|&)m_orderby=([^&]+)", 1)
    return F.struct(
        F.when(paged, head).otherwise(full).alias("path"),
        F.when(usable, value.try_cast("long")).otherwise(F.lit(1).cast("long")).alias("page"),
        F.when(orderby != "", orderby).alias("orderby"),
    )


def normalize_catalog_path(value: ColumnLike) -> Column:
    t = strip(col(value))
    absolute = (url_scheme(t) != "") & (url_netloc(t) != "")
    path = F.when(url_path(t) == "", "/").otherwise(url_path(t))
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("string"))
        .when(absolute, path)
        .when(~t.startswith("/"), F.concat(F.lit("/"), t))
        .otherwise(t)
    )


def is_content_url(url: ColumnLike) -> Column:
    """A series page: not a chapter, genre or listing page."""
    path = F.regexp_replace(F.regexp_replace(F.lower(url_path(url)), "^/+", ""), r"/+\z", "")
    segments = F.split(path, "/")
    next_of = lambda word: F.try_element_at(
        segments, F.array_position(segments, F.lit(word)).cast("int") + 1
    )
    def held(word: str) -> Column:
        following = next_of(word)
        return F.coalesce(~following.isin("page", "genre", "category", "tag"), F.lit(False))

    word = (
        F.when(F.array_contains(segments, "manga"), held("manga"))
        .when(F.array_contains(segments, "webtoon"), held("webtoon"))
        .otherwise(F.lit(False))
    )
    blocked = any_of([
        path == "", path.contains("/chapter"), path.contains("chapter-"),
        path.startswith("manga-genre"), path.startswith("webtoon-genre"),
    ])
    return ~blocked & word


def host_allowed(url: ColumnLike, domains: list[str]) -> Column:
    """Host is one of the domains, below one, or a CDN path around one."""
    host, path = url_host(url), F.lower(url_path(url))
    direct = any_of([(host == d) | host.endswith(f".{d}") for d in domains])
    wrapped = any_of([path.contains(f"/{d}/") for d in domains])
    cdn = (host == "wp.com") | host.endswith(".wp.com")
    return (host != "") & (direct | (cdn & wrapped))


def cookie_domain_matches(cookie_domain: ColumnLike, host: ColumnLike) -> Column:
    d, h = F.lower(F.regexp_replace(col(cookie_domain), r"^\.+", "")), F.lower(col(host))
    return (col(cookie_domain) != "") & (h != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d)))


def looks_like_challenge(html: ColumnLike) -> Column:
    text = F.lower(F.coalesce(col(html), F.lit("")))
    return any_of([text.contains(m) for m in CHALLENGE_MARKERS])


def cover_key(url: ColumnLike) -> Column:
    """Content-addressed cover file name."""
    name = F.element_at(F.split(url_path(url), "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)\z", 1))
    ext = F.when(ext.isin(*IMAGE_EXTENSIONS), ext).otherwise(F.lit(".jpg"))
    return F.concat(F.sha2(col(url), 256), ext)


def http_outcome(code: ColumnLike) -> Column:
    c = col(code)
    return F.when(c == 403, "forbidden").when(c >= 400, "error").when(c.isNotNull(), "ok")


def public_url(path: ColumnLike, root: ColumnLike, mtime: ColumnLike) -> Column:
    """Public address of a data file with its version; a raw/ root keeps its name."""
    p, r = col(path), F.regexp_replace(col(root), r"/+\z", "")
    rel = F.substring(p, F.length(r) + 2, F.length(p))
    raw = F.element_at(F.split(r, "/"), -1) == "raw"
    rel = F.when(raw, F.concat(F.lit("raw/"), rel)).otherwise(rel)
    url = F.concat(F.lit("/data/"), rel)
    return F.when(col(mtime).isNull(), url).otherwise(
        F.concat(url, F.lit("?v="), col(mtime).cast("string"))
    )
