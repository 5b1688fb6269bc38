"""The node table against a reading that copies every text to all elements around it."""

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pageloom.constants import BLOCK_TAGS, BOILERPLATE_TAGS
from pageloom.operators import html as H
from pageloom.sources.html import VOID, extract_nodes


class Tree(HTMLParser):
    """Whole element tree; an unclosed element ends with its parent."""

    def __init__(self, page):
        super().__init__()
        self.root = self.here = {"tag": "", "up": None, "parts": []}
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "up": self.here, "parts": []}
        self.here["parts"].append(node)
        if tag not in VOID:
            self.here = node

    def handle_endtag(self, tag):
        node = self.here
        while node and node["tag"] != tag:
            node = node["up"]
        if node and node is not self.root:
            self.here = node["up"]

    def handle_data(self, data):
        if self.here is not self.root:
            self.here["parts"].append(data)


def shown(node):
    """Stripped texts outside of boilerplate, in order."""
    for part in node["parts"]:
        if isinstance(part, str):
            if part.strip():
                yield part.strip()
        elif part["tag"] not in BOILERPLATE_TAGS:
            yield from shown(part)


def inside(node):
    for part in node["parts"]:
        if not isinstance(part, str) and part["tag"] not in BOILERPLATE_TAGS:
            yield part
            yield from inside(part)


def expected(page):
    """(score, paragraphs) of the best block."""
    best = None
    for place, node in enumerate(inside(Tree(page).root)):
        if node["tag"] not in (*BLOCK_TAGS, "body"):
            continue
        texts = list(shown(node))
        marked = [p for p in (" ".join(" ".join(shown(n)).split()) for n in inside(node) if n["tag"] == "p") if p]
        score = len(" ".join(" ".join(texts).split())) + 25 * len(marked)
        rank = (node["tag"] == "body", -score, place)
        if best is None or rank < best[0]:
            best = (rank, score, marked or [p.strip() for p in re.split("\n{2,}", "\n".join(texts)) if p.strip()])
    return best[1:] if best and best[1] > 0 else None


def random_page(rnd):
    parts = []
    for _ in range(rnd.randrange(50)):
        tag = rnd.choice(("p", "div", "article", "nav", "b", "body", "section", "aside", "h1"))
        parts.append(rnd.choice((f"<{tag}>", f"<{tag}>", f"</{tag}>", "<br>", "word", " two  words ", "x &amp; y", "\n")))
    return "".join(parts)


def test_best_block_against_a_tree(spark):
    rnd = random.Random(8)
    rows = [(i, "https://x.org/", random_page(rnd)) for i in range(1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.score, r.paragraphs) for r in H.main_content(extract_nodes(pages)).collect()}
    want = {i: e for i, _, page in rows if (e := expected(page))}
    assert len(want) > 300 and got == want


def test_awkward_pages(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (2, "u", ""), (3, "u", "text only"), (4, "u", "<p>never closed"), (5, "u", "<body><script>x</script>")],
        "page_id int, url string, html string",
    ).withColumns({"text": F.lit("clash"), "pos": F.lit(1)})
    rows = H.article_fields(extract_nodes(pages)).collect()
    assert {r.page_id: r.paragraphs for r in rows} == {i: [] for i in range(1, 6)}
    assert all(v is None for r in rows for k, v in r.asDict().items() if k not in ("page_id", "paragraphs"))
    assert H.article_fields(extract_nodes(pages.where("page_id > 9"))).count() == 0


def test_one_parse_and_one_exchange(spark, tables):
    out = H.article_fields(extract_nodes(tables.pages))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Aggregate") == 1 and "Join" not in plan


def test_deep_nesting_stays_linear(spark):
    """A block inside 3,000 others: each text is stored once."""
    page = "".join(f"<div class='c{i}'>some text number {i}" for i in range(3000))
    nodes = extract_nodes(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))
    size = F.coalesce(F.length("text"), F.lit(0)) + F.aggregate(
        F.concat(F.coalesce("texts", F.array().cast("array<string>")), F.coalesce("around", F.array().cast("array<string>"))),
        F.lit(0), lambda n, s: n + F.length(s),
    )
    assert nodes.agg(F.sum(size)).first()[0] < 4 * len(page)
    best = H.main_content(nodes).first()
    assert best.paragraphs == ["\n".join(f"some text number {i}" for i in range(3000))]
