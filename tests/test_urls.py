"""URL joining in columns against the standard library."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from pageloom.functions.urls import normalize_url
from pageloom.operators import html as H
from pageloom.sources.html import extract_nodes

BASES = [
    None, "", "http://a/b/c/d;p?q", "https://x.org", "https://x.org/", "HTTP://x.org/a/b/", "https://u:p@h:80/x/y?k=v#f", "a/b", "/r/s", "file",
    "mailto:me@x.org", "ftp://h/a;type=i", "file:///a/b", "//net/p", "https://x.org/a//b/../c", "ws://h/a;b/c;d", "http://[::1]/a", "http://[x/a", "?q", "data:a/b",
]
# the examples of RFC 3986, 5.4, and others
REFERENCES = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g",
    "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h",
    "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g#s/../x", "http:g", "http://other/../x", "HTTPS://x.org/y", "mailto:a@b", "data:image/png;base64,AA//..",
    "javascript:void(0)", "a//b///c", "//h//x", "/", "//", "///x", "g;", ";", "/;a;b", "?", "#", "a?#", "  /lead", "a\nb", "http://[bad/x", "1:x", "ftp:x", None,
    "é/ü?ö#ß", "a/;/..;x", "...", "/a/b?c=d#e#f", "/a/.b", "/a?b/../c", "https://x.org?q", "https://x.org#", "http://h/a/../b", "http://h/a;", "/a;b/c", "http://h", "/a?#", "a/" * 200 + "../" * 150 + "end",
]


def expected(base, url):
    if url is None:
        return None
    if url.startswith("//"):
        return "https:" + url
    try:
        return urljoin(base or "", url)
    except ValueError:
        return url


def test_join_against_the_library(spark):
    rnd = random.Random(9)
    piece = lambda: "".join(rnd.choice(("/", "/", ".", "..", "a", "b;c", ";", "?", "#", ":", "http:", "x.org", "//", " ")) for _ in range(rnd.randrange(9)))
    pairs = [(b, r) for b in BASES for r in REFERENCES] + [(rnd.choice(BASES), piece()) for _ in range(6000)]
    pairs += [(piece(), piece()) for _ in range(6000)]
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i long, b string, r string")
    got = {r.i: r.v for r in df.select("i", normalize_url("b", "r").alias("v")).collect()}
    wrong = [(b, r, got[i], expected(b, r)) for i, (b, r) in enumerate(pairs) if got[i] != expected(b, r)]
    assert not wrong, (len(wrong), wrong[:12])


def test_no_python_in_link_joining(spark, tables):
    nodes = extract_nodes(tables.pages)
    for out in (H.extract_links(nodes), H.extract_images(tables.pages, nodes), H.extract_cards(nodes), H.extract_chapters(nodes), H.article_fields(nodes)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan
    assert nodes.select(F.count(F.lit(1))).first()[0] > 0
