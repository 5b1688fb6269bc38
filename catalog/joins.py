"""Join queries over regions, pages and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import query
from pageloom.functions import geometry as G
from pageloom.operators import joins as J
from pageloom.plans.views import add_hierarchy

AREA = "CAST({0}.x2-{0}.x1 AS BIGINT)*({0}.y2-{0}.y1)"
INTER = "(least(a.x2,b.x2)-greatest(a.x1,b.x1))::BIGINT*(least(a.y2,b.y2)-greatest(a.y1,b.y1))"
CROSS = "least(a.x2,b.x2) > greatest(a.x1,b.x1) AND least(a.y2,b.y2) > greatest(a.y1,b.y1)"


def pages_of(t):
    return add_hierarchy(t._paged_lines.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")))


PAGES = """, pg AS (SELECT DISTINCT page_id, CAST(floor(page_id/12) AS BIGINT) AS chapter_id, page_id % 12 + 1 AS page_no
  FROM paged),
 nb AS (SELECT page_id, chapter_id, page_no, lag(page_id) OVER w AS prev_page, lead(page_id) OVER w AS next_page
   FROM pg WINDOW w AS (PARTITION BY chapter_id ORDER BY page_no, page_id))
"""


def neighbours(t):
    pages = pages_of(t).select("page_id", "chapter_id", "page_no")
    return J.page_neighbours(pages, ["chapter_id"], profile=t.profile("pages", pages, ["chapter_id"]))


@query("page_neighbours", PAGES + "SELECT * FROM nb", ("paged",))
def _(t):
    return neighbours(t)


def _strict_noise(top: str, height: str) -> str:
    return f"""(base = '' OR source_text = '' OR w < 15 OR h < 10 OR w/greatest(h,1) > 20 OR w/greatest(h,1) < 0.05
    OR (length(source_text) <= 3 AND confidence < 0.85 AND NOT {S.has('source_text', '[^\\x{00}-\\x{7F}]')})
    OR ({S.has('base', '^[0-9,.]+$')} AND (length(base) >= 4 OR contains(base, ',') OR {top} > {height}*0.8 OR w > h*3))
    OR {S.has('base', '^[0OoSs]+$')} OR {S.has('base', '(?i)[.](com|net|org|io|cn)$')}
    OR {S.has('base', '^[A-Z]+SCANS?$')} OR {S.has('base', '^[A-Z]+COMICS?$')}
    OR (NOT {S.has('base', '[^\\x{00}-\\x{7F}]')} AND length(base) > 15 AND NOT contains(base, ' ') AND NOT {S.has('base', '[a-z]')})
    OR {S.has('base', '[\\\\$^_{}]')} OR {S.has('base', '^[A-Za-z]{1,2}[0-9]{2,4}$')}
    OR ({S.has('base', '^[0-9]+(' + S.WS + '+[0-9]+)+$')} AND length({S.nonspace('base')}) <= 4)
    OR {S.has('base', '^[-\\x{2212}\\x{2013}\\x{2014}]+$')} OR {S.has('base', '^[I1l|]+$')} OR {S.has('base', '^[.]+$')}
    OR {S.has('base', '^[A-Za-z]$')} OR {S.has('base', '^[A-Za-z][0-9][.]$')} OR {S.has('base', '^[A-Z]{2}$')}
    OR {S.has('base', '^[a-z][0-9]$')} OR {S.has('base', '^0+[A-Za-z]+$')} OR {S.has('base', '^[A-Za-z]+0+$')})"""


# page height 1850 keeps some regions inside the lower band (256 pixels)
@query("match_edge_bands", PAGES + f""", r AS (SELECT *, {S.base('source_text')} AS base, x2-x1 AS w, y2-y1 AS h FROM regions),
 bot AS (SELECT r.*, nb.next_page, NOT {_strict_noise('(y1 - (1850-256))', '256')} AS clean FROM r JOIN nb USING (page_id)
   WHERE y1 >= 1850-256 AND nb.next_page IS NOT NULL),
 top AS (SELECT r.*, NOT {_strict_noise('y1', '256')} AS clean FROM r WHERE y2 <= 256),
 pairs AS (SELECT a.page_id, a.region_id AS bid, a.clean AS bc, b.page_id AS np, b.region_id AS tid, b.pos AS tpos,
    b.source_text AS ttext, b.clean AS tc,
    substr(md5(CAST(floor(b.x1/5) AS BIGINT) || '|' || CAST(floor(b.y1/5) AS BIGINT) || '|' || {S.strip('lower(b.source_text)')}), 1, 12) AS pid
  FROM bot a JOIN top b ON a.next_page = b.page_id
   AND least(a.x2,b.x2)-greatest(a.x1,b.x1) > 0
   AND (least(a.x2,b.x2)-greatest(a.x1,b.x1))/greatest(least(a.w,b.w),1) >= 0.5 AND abs(b.y1 - (a.y2-1850)) <= 64)
SELECT page_id, bid AS region_id, 'current_bottom' AS role, arg_min(pid, tpos) AS pair_id,
   string_agg(ttext, '|' ORDER BY tpos) FILTER (ttext <> '') AS texts FROM pairs WHERE tc GROUP BY 1, 2
UNION ALL
SELECT np, tid, 'next_top', any_value(pid), NULL FROM pairs WHERE bc GROUP BY 1, 2""", ("regions",))
def _(t):
    out = J.match_edge_bands(t.regions, neighbours(t), 1850)
    return out.select("page_id", "region_id", "role", "pair_id", F.array_join("crosspage_texts", "|").alias("texts"))


@query("pair_id", f"""SELECT region_id, substr(md5(CAST(floor(x1/5) AS BIGINT) || '|' || CAST(floor((y1-900)/5) AS BIGINT) || '|' ||
   {S.strip('lower(source_text)')}), 1, 12) AS pair_id FROM regions""", ("regions",))
def _(t):
    return t.regions.select("region_id", J.pair_id(F.col("x1"), F.col("y1") - 900, F.col("source_text")).alias("pair_id"))


@query("edge_group_candidates", """, bt AS (SELECT page_id, region_id AS g, x1, x2 FROM lines WHERE y2 >= 2000*0.88),
  tp AS (SELECT page_id - 1 AS page_id, region_id AS g, x1, x2 FROM lines WHERE y1 <= 2000*0.12)
 SELECT a.page_id, a.g AS bottom_group, b.g AS top_group,
   CAST(least(a.x2,b.x2)-greatest(a.x1,b.x1) AS DOUBLE)/least(a.x2-a.x1,b.x2-b.x1) AS overlap
 FROM bt a JOIN tp b USING (page_id) WHERE least(a.x2,b.x2)-greatest(a.x1,b.x1) >= 0.2*least(a.x2-a.x1,b.x2-b.x1)""", ("lines",))
def _(t):
    g = t.lines.withColumn("group_id", F.col("region_id"))
    bottom = g.where(F.col("y2") >= 2000 * 0.88).select("page_id", "group_id", "x1", "x2", "y1", "y2")
    top = g.where(F.col("y1") <= 2000 * 0.12).select((F.col("page_id") - 1).alias("page_id"), "group_id", "x1", "x2", "y1", "y2")
    return J.edge_group_candidates(bottom, top)


# containers: every region grown on all sides
CONTAINERS = """, cont AS (SELECT page_id, region_id AS container_id, x1 - 30 AS x1, y1 - 20 AS y1, x2 + 30 AS x2, y2 + 20 AS y2
  FROM lines)
"""


def containers(t):
    return t.lines.select(
        "page_id", F.col("region_id").alias("container_id"), (F.col("x1") - 30).alias("x1"),
        (F.col("y1") - 20).alias("y1"), (F.col("x2") + 30).alias("x2"), (F.col("y2") + 20).alias("y2"),
    )


@query("assign_container", CONTAINERS + f""", c AS (SELECT a.page_id, a.region_id, b.container_id,
    CAST({INTER} AS DOUBLE)/greatest(1, {AREA.format('a')}) AS ov, greatest(1, {AREA.format('b')}) AS barea, greatest(1, {AREA.format('a')}) AS rarea
   FROM lines a JOIN cont b ON a.page_id = b.page_id AND {CROSS}),
 s AS (SELECT *, ov >= 0.35 AND barea >= rarea*1.6 AS strict FROM c WHERE ov >= 0.18 AND barea >= rarea*0.9),
 f AS (SELECT *, bool_or(strict) OVER (PARTITION BY page_id) AS has_strict FROM s),
 k AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY ov DESC, barea, container_id) AS rn FROM f WHERE strict OR NOT has_strict)
 SELECT page_id, region_id, container_id, ov AS overlap, NOT has_strict AS relaxed FROM k WHERE rn = 1""", ("lines",))
def _(t):
    return J.assign_container(t.lines, containers(t))


@query("assign_component", f""", comp AS (SELECT page_id, region_id AS component_id, x1 + 40 AS x1, y1 - 60 AS y1, x2 + 10 AS x2, y2 - 10 AS y2 FROM lines),
 c AS (SELECT a.component_id, b.region_id, {INTER} AS inter, b.pos, greatest(1, {AREA.format('a')}) AS area
  FROM comp a JOIN lines b ON a.page_id = b.page_id AND {CROSS}),
 k AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY inter DESC, pos) AS rn FROM c)
 SELECT comp.page_id, comp.component_id, k.region_id FROM comp LEFT JOIN k ON k.component_id = comp.component_id AND rn = 1 AND inter/area >= 0.02""", ("lines",))
def _(t):
    comp = t.lines.select(
        "page_id", F.col("region_id").alias("component_id"), (F.col("x1") + 40).alias("x1"),
        (F.col("y1") - 60).alias("y1"), (F.col("x2") + 10).alias("x2"), (F.col("y2") - 10).alias("y2"),
    )
    return J.assign_component(comp, t.lines)


@query("candidate_pairs", f"""SELECT a.page_id, a.region_id AS first_id, b.region_id AS second_id,
   CAST({INTER} AS DOUBLE)/({AREA.format('a')} + {AREA.format('b')} - {INTER}) AS iou
 FROM lines a JOIN lines b ON a.page_id = b.page_id AND a.pos < b.pos AND {CROSS}""", ("lines",))
def _(t):
    """All overlapping pairs of a page: the range join by itself."""
    pairs = J.candidate_pairs(t.lines, G.intersects)
    a, b = G.Box(alias="a"), G.Box(alias="b")
    return pairs.select(
        F.col("a.page_id").alias("page_id"), F.col("a.region_id").alias("first_id"),
        F.col("b.region_id").alias("second_id"), G.iou(a, b).alias("iou"),
    )


# reports: each order is a report on a page of its customer
REPORTS = """, rep AS (SELECT o_custkey % 500 AS page_id, o_orderkey AS report_id, epoch(o_orderdate)::BIGINT AS mtime FROM orders)
"""


def reports(t):
    return t.orders.select(
        (F.col("o_custkey") % 500).alias("page_id"), F.col("o_orderkey").alias("report_id"),
        F.unix_timestamp("o_orderdate").alias("mtime"),
    )


@query("latest_report_per_page", REPORTS + """, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY mtime DESC, report_id DESC) AS rn FROM rep)
 SELECT p.page_id, k.report_id, k.mtime FROM (SELECT DISTINCT page_id FROM paged) p LEFT JOIN k ON k.page_id = p.page_id AND rn = 1""", ("paged",))
def _(t):
    pages = t._paged_lines.select("page_id").distinct()
    return J.latest_report_per_page(pages, reports(t))


@query("latest_artifact", """WITH art AS (SELECT o_custkey AS stem, 'p' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '_slices.json' ELSE '.' || substr('pngwebjpg', CAST(o_orderkey % 3 AS INT)*3+1, 3) END AS name,
   epoch(o_orderdate)::BIGINT AS mtime FROM orders)
 SELECT stem, name, mtime FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY mtime DESC, name DESC) AS rn FROM art) WHERE rn = 1""")
def _(t):
    m = F.col("o_orderkey") % 3
    tail = F.when(m == 0, "_slices.json").when(m == 1, ".web").otherwise(".jpg")
    files = t.orders.select(
        F.col("o_custkey").alias("stem"), F.concat(F.lit("p"), F.col("o_custkey").cast("string"), tail).alias("name"),
        F.unix_timestamp("o_orderdate").alias("mtime"),
    )
    return J.latest_per_key(files, ["stem"], "mtime", "name", ["name", "mtime"])


CARRY = """, rows_ AS (SELECT region_id, 'c' || (region_id % 700) AS pair_id FROM lines),
 car AS (SELECT 'c' || (o_custkey % 900) AS pair_id, 'text ' || o_orderkey AS bottom_text, o_orderkey AS created_at FROM orders),
 newest AS (SELECT pair_id, arg_max(bottom_text, created_at) AS carried_text FROM car GROUP BY 1)
"""


def carry(t):
    rows = t.lines.select(
        "region_id", F.concat(F.lit("c"), (F.col("region_id") % 700).cast("string")).alias("pair_id")
    )
    carried = t.orders.select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 900).cast("string")).alias("pair_id"),
        F.concat(F.lit("text "), F.col("o_orderkey").cast("string")).alias("bottom_text"),
        F.col("o_orderkey").alias("created_at"),
    )
    return rows, carried


@query("consume_carryover", CARRY + """, f AS (SELECT pair_id, min(region_id) AS region_id FROM rows_ GROUP BY 1)
 SELECT r.region_id, r.pair_id, n.carried_text, coalesce(n.carried_text = '', true) AS translate
 FROM rows_ r LEFT JOIN f ON f.region_id = r.region_id LEFT JOIN newest n ON n.pair_id = f.pair_id""", ("lines",))
def _(t):
    return J.consume_carryover(*carry(t))


@query("unconsumed_carryover", CARRY + "SELECT * FROM car WHERE pair_id NOT IN (SELECT pair_id FROM rows_)", ("lines",))
def _(t):
    return J.unconsumed_carryover(*carry(t))


@query("consistency_join")
def _(t):
    second = t.regions.select("page_id", "region_id", F.upper(F.substring("source_text", 1, 14)).alias("source_text"))
    return J.consistency_join(t.regions, second, 2.0, 2.0, 1600, 4000, min_box=30)


@query("source_stat_join", """WITH ch AS (SELECT DISTINCT l_orderkey % 997 AS chapter_id FROM lineitem),
 man AS (SELECT o_custkey % 997 AS chapter_id, count(*) FILTER (o_orderstatus = 'F') AS ok_count,
    CASE WHEN o_custkey % 997 % 10 <> 0 THEN count(*) END AS total FROM orders WHERE o_custkey % 997 % 3 <> 0 GROUP BY 1, o_custkey % 997 % 10),
 fil AS (SELECT c_custkey % 997 AS chapter_id, count(*) AS images FROM customer WHERE c_custkey % 997 % 7 <> 0 GROUP BY 1)
 SELECT chapter_id, coalesce(CASE WHEN total IS NOT NULL THEN ok_count END, images, 0) > 0 AS downloaded,
   coalesce(CASE WHEN total IS NOT NULL THEN ok_count END, images, 0) AS downloaded_count, coalesce(total, images, 0) AS downloaded_total
 FROM ch LEFT JOIN man USING (chapter_id) LEFT JOIN fil USING (chapter_id)""")
def _(t):
    chapters = t.lineitem.select((F.col("l_orderkey") % 997).alias("chapter_id")).distinct()
    m = t.orders.withColumn("chapter_id", F.col("o_custkey") % 997).where("chapter_id % 3 <> 0").groupBy("chapter_id").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("ok_count"), F.count(F.lit(1)).alias("n")
    )
    manifests = m.select("chapter_id", "ok_count", F.when(F.col("chapter_id") % 10 != 0, F.col("n")).alias("total"))
    files = t.customer.withColumn("chapter_id", F.col("c_custkey") % 997).where("chapter_id % 7 <> 0").groupBy("chapter_id").agg(
        F.count(F.lit(1)).alias("images")
    )
    return J.source_stat_join(chapters, manifests, files)


@query("translated_pages", "SELECT page_id, chapter_id FROM page_facts WHERE has_output", ("page_facts",))
def _(t):
    outputs = t._paged_lines.select("page_id").where("page_id % 5 <> 0")
    return J.translated_pages(t.page_facts.select("page_id", "chapter_id"), outputs, ["page_id"])


@query("run_compare", """, m AS (SELECT 'w' || (series_id % 3) AS workload, page_id % 2 AS run, ocr_ms, translator_ms FROM page_facts),
 l AS (SELECT workload, run, 'ocr_p50' AS metric, CAST(quantile_disc(ocr_ms, 0.5) AS DOUBLE) AS value FROM m GROUP BY 1, 2
   UNION ALL SELECT workload, run, 'translator_p95', CAST(quantile_disc(translator_ms, 0.95) AS DOUBLE) FROM m GROUP BY 1, 2)
 SELECT b.workload, b.metric, b.value AS base_value, c.value AS new_value, (c.value-b.value)/b.value AS change,
   (c.value-b.value)/b.value <= -(CASE b.metric WHEN 'ocr_p50' THEN 0.2 ELSE 0.3 END) AS met
 FROM l b JOIN l c ON b.workload = c.workload AND b.metric = c.metric AND b.run = 0 AND c.run = 1""", ("page_facts",))
def _(t):
    m = t.page_facts.select(
        F.concat(F.lit("w"), (F.col("series_id") % 3).cast("string")).alias("workload"),
        (F.col("page_id") % 2).alias("run"), "ocr_ms", "translator_ms",
    ).groupBy("workload", "run").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ocr_ms)").alias("ocr_p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY translator_ms)").alias("translator_p95"),
    )
    long = m.unpivot(["workload", "run"], ["ocr_p50", "translator_p95"], "metric", "value")
    side = lambda r: long.where(F.col("run") == r)
    return J.run_compare(side(0), side(1), {"ocr_p50": 0.2, "translator_p95": 0.3})


@query("uncached", """WITH pg AS (SELECT page_id, url AS path, 'korean' AS lang, length(html) AS size, page_id * 1000 AS mtime_ns FROM pages),
 k AS (SELECT *, sha1(path || ':' || lang || ':' || size || ':' || mtime_ns || ':v1') AS cache_key FROM pg)
 SELECT page_id, cache_key FROM k WHERE page_id % 3 <> 0""")
def _(t):
    pages = t.pages.select(
        "page_id", F.col("url").alias("path"), F.lit("korean").alias("lang"),
        F.length("html").cast("long").alias("size"), (F.col("page_id") * 1000).alias("mtime_ns"),
    )
    stored = pages.where("page_id % 3 = 0").select(J.cache_key("path", "lang", "size", "mtime_ns").alias("cache_key"))
    return J.uncached(pages, stored).select("page_id", "cache_key")


@query("drop_keys", """SELECT page_id, chapter_id FROM page_facts WHERE chapter_id NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 4 = 0)""", ("page_facts",))
def _(t):
    dropped = t.lineitem.where("l_suppkey % 4 = 0").select(F.col("l_suppkey").alias("chapter_id"))
    return J.drop_keys(t.page_facts.select("page_id", "chapter_id"), dropped, ["chapter_id"])


@query("missing_keys", """SELECT DISTINCT c_custkey AS chapter_id FROM customer WHERE c_custkey NOT IN (SELECT chapter_id FROM page_facts)
   AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)""", ("page_facts",))
def _(t):
    asked = t.customer.select(F.col("c_custkey").alias("chapter_id"))
    known = [t.page_facts.select("chapter_id"), t.supplier.select(F.col("s_suppkey").alias("chapter_id"))]
    return J.missing_keys(asked, known, ["chapter_id"])


@query("skip_existing", """SELECT page_id, url AS path FROM pages WHERE page_id % 4 <> 0 OR page_id % 8 = 0""")
def _(t):
    items = t.pages.select("page_id", F.col("url").alias("path"))
    files = t.pages.where("page_id % 4 = 0").select(
        F.col("url").alias("path"), F.when(F.col("page_id") % 8 == 0, 0).otherwise(F.length("html")).alias("length")
    )
    return J.skip_existing(items, files)
