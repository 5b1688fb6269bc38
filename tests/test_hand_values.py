"""Small inputs with results worked out by hand."""

from collections import namedtuple

from pyspark.sql import functions as F

from pageloom.functions import cleaning, geometry, noise, script, sfx, text, urls
from pageloom.operators import greedy, html, merging, scoring, windows
from pageloom.params import GroupRule, TileRule
from pageloom.sources.html import extract_nodes

REGION = (
    "page_id long, region_id long, pos long, x1 int, y1 int, x2 int, y2 int, source_text string, confidence double, "
    "is_sfx boolean, is_watermark boolean, container_id long"
)


def regions(spark, *rows):
    full = [
        (1, i + 1, i + 1, *r[:4], r[4], r[5] if len(r) > 5 else 0.9, False, len(r) > 6 and r[6], None)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, REGION)


def values(spark, make, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_scripts(spark):
    assert values(spark, script.script_bucket, "안녕", "hi", "你好", "hi 你", "12", "") == ["hangul", "latin", "cjk", "mixed", None, None]
    assert values(spark, script.has_cjk, "你好", "[翻译失败] 你好", None) == [True, False, False]
    assert values(spark, script.english_ratio, "ab 你好", "", None)[0] == 0.5


def test_sound_effects(spark):
    assert values(spark, sfx.is_sfx, "BOOM!", "OK!", "쾅", "두두두", "HAHA", "hello", "!?", "쿠쿵쿠쿵", "이수희") == [
        True, False, True, True, True, False, True, True, False,
    ]
    assert values(spark, sfx.translate_sfx, "쾅!", "boom!!", "모름?", "...", "") == ["轰!", "轰!!", "모름?", "...", ""]


def test_noise_keeps_domains_when_relaxed(spark):
    args = (F.lit(100), F.lit(30), F.lit(10), F.lit(0.9), 800)
    assert values(spark, lambda c: noise.noise_reason(c, *args, relaxed=True), "site.com") == [None]
    assert values(spark, lambda c: noise.noise_reason(c, *args), "site.com") == ["domain"]
    assert values(spark, noise.ocr_noise_reason, "A1_$", "AB", "A12", "12", "1 2", "BOOM!") == [
        "符号噪声", "短大写缩写", "短字母数字", "短数字", "分隔数字", None,
    ]


def test_cleaning(spark):
    assert values(spark, cleaning.clean_annotations, "TEXT: 你好 (Note: polite)", "翻译：好（x）", None) == ["你好", "好（x）", None]
    assert values(spark, lambda c: cleaning.normalize_text(c, F.lit("ko")), " 이닌\n 억은 ") == ["이번 역은"]


def test_text_splitting(spark):
    cut = lambda c: text.split_by_punctuation(c)
    assert [tuple(r) for r in values(spark, cut, "你好吗？我很好。", "abcd", "", "没有标点的句子")] == [
        ("你好吗？", "我很好。"), ("ab", "cd"), ("", ""), ("没有标", "点的句子"),
    ]
    pairs = values(spark, text.parse_top_bottom, '{"top":"a","bottom":"b"}', '{"top":"a", "bottom":"b c', "plain")
    assert tuple(pairs[0]) == ("a", "b") and tuple(pairs[1]) == ("a", "b c") and pairs[2] is None
    shares = values(spark, lambda c: text.split_by_ratio(F.array(F.lit("abc"), F.lit("abc")), c), "你好，世界真大。", "", "ab")
    assert shares == [["你好，", "世界真大。"], ["", ""], ["a", "b"]]
    joined = values(spark, lambda c: text.join_script_aware(F.split(c, ",")), "a,b,你,c")
    assert joined == ["a b你c"]


def test_levenshtein(spark):
    got = values(spark, lambda c: F.round(text.levenshtein_ratio(c, F.lit("kitten")), 4), "sitting", "kitten", "")
    assert got == [round(1 - 3 / 7, 4), 1.0, 0.0]


def test_urls(spark):
    assert values(spark, urls.infer_id, "https://a.org/manga/x/", "x") == ["x", "x"]
    allowed = lambda c: urls.host_allowed(c, ["toongod.org"])
    assert values(spark, allowed, "https://i0.wp.com/toongod.org/a.jpg", "https://cdn.toongod.org/a", "https://toongod.org.evil.com/") == [True, True, False]
    assert values(spark, urls.is_content_url, "https://a.org/manga/x/", "https://a.org/manga/page/2", "https://a.org/manga/x/chapter-1") == [True, False, False]
    got = [tuple(r) for r in values(spark, urls.parse_range, "10-3", "0-2", "x")]
    assert got == [(3, 10, None), (None, None, "not_positive"), (None, None, "bad_format")]
    assert values(spark, urls.slugify, " My_Great  Title! ") == ["my-great-title"]


def test_line_merge(spark):
    lines = [(10, 100, 60, 130, "너무", 0.9), (70, 102, 120, 132, "좋아", 0.9)]
    one = greedy.merge_group_lines(regions(spark, *lines).withColumn("group_id", F.lit(1).cast("long"))).collect()
    assert [(r.source_text, r.x1, r.y1, r.x2, r.y2) for r in one] == [("너무좋아", 10, 100, 120, 132)]
    marked = [*lines, (500, 20, 680, 50, "NEWTOKI", 0.9, True)]
    two = greedy.merge_group_lines(regions(spark, *marked).withColumn("group_id", F.lit(1).cast("long"))).collect()
    assert sorted(r.source_text for r in two) == ["NEWTOKI", "너무좋아"]


def test_same_line(spark):
    near = regions(spark, (10, 10, 60, 40, "hello"), (65, 11, 120, 41, "world"))
    assert [r.source_text for r in merging.merge_same_line(near).collect()] == ["hello world"]
    far = regions(spark, (10, 10, 60, 40, "hello"), (200, 11, 260, 41, "world"))
    assert merging.merge_same_line(far).count() == 2


def test_groups_hold_four_at_most(spark):
    rows = [(10, 10 + 22 * i, 110, 30 + 22 * i, "line") for i in range(6)]
    groups = greedy.group_adjacent(regions(spark, *rows)).groupBy("group_id").count().collect()
    assert sorted(r["count"] for r in groups) == [2, 4]
    loose = greedy.group_adjacent(regions(spark, *rows), GroupRule(max_group_size=None)).select("group_id").distinct()
    assert loose.count() == 1


def test_watermarks(spark):
    rows = regions(spark, (100, 500, 200, 530, "NewToki 95"), (300, 900, 380, 930, "abc"), (305, 905, 385, 935, "abc"), (10, 5, 60, 30, "ab12"), (300, 500, 380, 530, "sitexcom"))
    got = windows.watermark_flag(rows, 2000, 800).orderBy("pos")
    assert [r.watermark_rule for r in got.collect()] == ["keyword", None, "repeat", "edge", "domain"]


def test_intervals(spark):
    page = lambda h: spark.createDataFrame([(h,)], "height long")
    rule = TileRule(tile_height=100, overlap_ratio=0.5, min_tile_height=20, edge_padding=10, edge_band_ratio=0.2, edge_band_min_height=30)
    tiles = windows.tiles(page(230), rule=rule).orderBy("index").collect()
    assert [(r.start, r.end - r.start) for r in tiles] == [(0, 110), (40, 120), (90, 120), (140, 90)]
    edges = windows.edge_tiles(page(230), rule=rule).orderBy("index").collect()
    assert [(r.start, r.end - r.start) for r in edges] == [(0, 56), (174, 56)]
    counts = [windows.slices(page(h)).count() for h in (16383, 16384, 32000, 62012)]
    assert counts == [1, 2, 2, 4]
    spans = [(r.start, r.end) for r in windows.slices(page(62012)).orderBy("index").collect()]
    assert spans[0] == (0, 16000) and spans[1][0] == 15968 and spans[-1][1] == 62012


def test_bad_interval_sizes(spark):
    import pytest

    with pytest.raises(ValueError):
        windows.stripes(spark.range(1).withColumn("height", F.col("id")), 32, 32, 10)


def test_numbered_replies(spark):
    df = spark.createDataFrame([(1, 3, "1. a\n3) c"), (2, 2, "x / y"), (3, 2, "one\ntwo"), (4, 1, "1. a\n1. b\n2. c")], "batch_id long, n int, reply string")
    got = {(r.batch_id, r.item_no): r.text for r in scoring.parse_numbered(df).collect()}
    assert got == {(1, 1): "a", (1, 2): "", (1, 3): "c", (2, 1): "x", (2, 2): "y", (3, 1): "one", (3, 2): "two", (4, 1): "a"}


def test_failed_batch_is_marked(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", ""), (1, 2, 1, "b", "")], "page_id long, batch_no int, item_no int, text string, context string")

    def reply(texts, contexts):
        if "b" in texts:
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    got = {r.text: r.reply for r in scoring.score_batches(df, reply).collect()}
    assert got == {"a": "A", "b": "[翻译失败]"}


def test_batches_over_arrow_chunks(spark):
    """Batches stay whole when they straddle two Arrow chunks."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).select(
            F.lit(1).alias("page_id"), F.floor(F.col("id") / 5).cast("int").alias("batch_no"), (F.col("id") % 5).alias("item_no"),
            F.col("id").cast("string").alias("text"), F.lit("").alias("context"),
        )
        got = scoring.score_batches(df, lambda texts, contexts: [str(len(texts))] * len(texts), concurrency=2)
        assert [r.reply for r in got.select("reply").distinct().collect()] == ["5"]
        assert got.count() == 200
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_border_pair_end_to_end(spark):
    rows = [(1, 11, 1, 100, 900, 300, 980, "He"), (2, 21, 1, 110, 10, 310, 90, "llo")]
    df = spark.createDataFrame(rows, "page_id long, region_id long, pos long, x1 int, y1 int, x2 int, y2 int, source_text string")
    df = df.withColumn("group_id", F.col("region_id"))
    bottom = greedy.edge_groups(df, 1000, "bottom")
    top = greedy.edge_groups(df, 1000, "top").withColumn("page_id", F.col("page_id") - 1)
    pairs = greedy.pair_edge_groups(bottom, top)
    got = {r.region_id: r.target_text for r in scoring.crosspage_combine(pairs, df, lambda t, c: ["你好，世界啊" for _ in t]).collect()}
    assert got == {11: "你好，", 21: "世界啊"}


def test_font_size(spark):
    # 160 x 80 usable: 3 lines of 4 characters, 22 by height, 24 with the tighter spacing
    df = spark.createDataFrame([(0, 0, 200, 100, 0), (0, 0, 200, 100, 10)], "x1 int, y1 int, x2 int, y2 int, n int")
    assert [r[0] for r in df.orderBy("n").select(geometry.estimate_font_size(geometry.Box(), "n")).collect()] == [12, 24]


HTML = """<html><head><title> A &amp; B </title><meta property="og:title" content="Meta title">
<meta name="author" content="Ann"><meta property="og:image" content="/c.png">
<script type="application/ld+json">{"@type":"Article","headline":"Best","author":[{"name":"X"},{"name":"Y"}]}</script></head>
<body><nav><p>menu</p></nav><article><p>First <b>one</b></p><p>Second</p></article><a href="/b">plain</a>
<a href="/a"><img src="/i.png" alt="pic"></a></body></html>"""


def test_article(spark):
    pages = spark.createDataFrame([(1, "https://x.org/p/", HTML)], "page_id long, url string, html string")
    nodes = extract_nodes(pages)
    row = html.article_fields(nodes).first()
    assert (row.title, row.author, row.cover) == ("Best", "X, Y", "https://x.org/c.png")
    assert row.paragraphs == ["First one", "Second"] and row.summary == "First one"
    links = html.extract_links(nodes).orderBy(F.desc("with_image"), "pos").collect()
    assert [(r.url, r.title, r.cover_url) for r in links] == [
        ("https://x.org/a", "pic", "https://x.org/i.png"), ("https://x.org/b", "plain", None),
    ]


def test_json_objects_against_a_scan(spark):
    """Random replies; the expected objects come from cutting out literals first."""
    import random
    import re

    rnd = random.Random(5)
    replies = ["".join(rnd.choice('{}{}"\\a \n') for _ in range(rnd.randrange(40))) for _ in range(300)]
    replies += [None, "", "{" * 500 + "}" * 500, '{"a": "' + "x" * 100_000 + '"} {}']

    def expected(reply):
        masked = re.sub(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)', lambda m: "_" * len(m[0]), reply or "", flags=re.S)
        found, open_at = [], []
        for i, ch in enumerate(masked):
            if ch == "{":
                open_at.append(i)
            elif ch == "}" and open_at:
                first = open_at.pop()
                if not open_at:
                    found.append(reply[first:i + 1])
        return found

    from pageloom.functions.base import strip
    from pageloom.operators.scoring import parse_json_objects

    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    rows = df.select("reply", strip("reply").alias("s"), parse_json_objects("reply").alias("o")).collect()
    assert len(rows) == len(replies)
    for r in rows:
        assert r.o == expected(r.s), r.reply


def test_pack_by_chars_against_a_count(spark):
    """Batches by bisection equal those of a plain count, also for entries above the limit."""
    import random

    from pageloom.operators.greedy import _packer

    row = namedtuple("Row", "item_id size")
    rnd = random.Random(6)
    for _ in range(200):
        items = [row(i, rnd.choice((3, 5, 20, 400))) for i in range(rnd.randrange(40))]
        limit_n, limit_c = rnd.choice((0, 1, 5, 12)), rnd.choice((0, 10, 60, 300))
        got = _packer(limit_n, limit_c)(items)
        assert [g[0] for g in got] == [i.item_id for i in items]
        batches = {}
        for (_, b, no), item in zip(got, items):
            batches.setdefault(b, []).append(item.size + len(str(no)))
        sizes = list(batches.values())
        for k, own in enumerate(sizes):
            own[0] += len(str(len(sizes[k - 1]) + 1)) - 1 if k else 0
            assert len(own) == 1 or ((not limit_n or len(own) <= limit_n) and (not limit_c or sum(own) <= limit_c))
            if k + 1 < len(sizes):  # the next entry would not have fitted
                nxt = items[sum(map(len, sizes[:k + 1]))].size + len(str(len(own) + 1))
                assert (limit_n and len(own) == limit_n) or (limit_c and sum(own) + nxt > limit_c)


def test_same_text_without_a_box(spark):
    """A row without a box is a duplicate of any equal text; a null confidence counts as 0."""
    df = spark.createDataFrame(
        [(1, 11, 1, 0, 0, 10, 10, "a", 0.5), (1, 12, 2, None, None, None, None, "a", 0.9), (1, 13, 3, 0, 0, 10, 10, "a", None),
         (1, 14, 4, 500, 500, 510, 510, "b", None), (1, 15, 5, 500, 500, 510, 510, "b", 0.1),
         (1, 16, 6, None, None, None, None, None, 0.1), (1, 17, 7, None, None, None, None, None, 0.1),
         (2, 21, 1, None, None, None, None, "a", 0.9), (1, 18, 8, 700, 700, 710, 710, "c", 0.1)],
        "page_id long, region_id long, pos long, x1 int, y1 int, x2 int, y2 int, source_text string, confidence double",
    )
    kept = {r.region_id for r in greedy.dedup_same_text(df).collect()}
    assert kept == {12, 15, 16, 17, 18, 21}
