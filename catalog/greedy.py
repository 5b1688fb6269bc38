"""Deduplication, clustering and grouping queries.

The SQL twins serve the rows of a page one after the other in a recursive
query, which is how these rules are defined.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.joins import AREA, CROSS, INTER
from catalog.registry import query
from pageloom.operators import greedy as G
from pageloom.params import GroupRule
from pageloom.skew import KeyProfile

IOU = f"(CAST({INTER} AS DOUBLE)/({AREA.format('a')} + {AREA.format('b')} - {INTER}))"
BUCKET = """CASE WHEN {h}::INT + {l}::INT + {c}::INT > 1 THEN 'mixed' WHEN {h} THEN 'hangul' WHEN {l} THEN 'latin' WHEN {c} THEN 'cjk' END""".format(
    h=S.has("source_text", S.HANGUL), l=S.has("source_text", "[A-Za-z]"), c=S.has("source_text", S.CJK)
)


def pairs(t) -> KeyProfile:
    """Page sizes against the limit for pair rules."""
    return t.profile("pairs", t._paged_lines, ["page_id"], limit=G.PAIR_LIMIT)


# -- components ---------------------------------------------------------------
CLUSTER = f""", b AS (SELECT *, {BUCKET} AS sc, greatest(1, x2-x1) AS w, greatest(1, y2-y1) AS h FROM regions),
 p AS (SELECT *, greatest(4, least(120, CAST(round_even(w*0.15::DOUBLE, 0) AS BIGINT))) AS px, greatest(4, least(120, CAST(round_even(h*0.6::DOUBLE, 0) AS BIGINT))) AS py FROM b),
 e AS (SELECT a.page_id, a.region_id AS a, b.region_id AS b FROM p a JOIN p b ON a.page_id = b.page_id AND a.pos < b.pos
    AND a.x1-a.px <= b.x2+b.px AND a.x2+a.px >= b.x1-b.px AND a.y1-a.py <= b.y2+b.py AND a.y2+a.py >= b.y1-b.py
    AND NOT coalesce(a.sc <> b.sc AND a.sc <> 'mixed' AND b.sc <> 'mixed', false)
    AND greatest(b.y1-a.y2, a.y1-b.y2, 0) <= greatest(1.0, (a.h+b.h)/2)*2.8::DOUBLE
    AND (greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1))/least(a.w,b.w) >= 0.12 OR greatest(b.x1-a.x2, a.x1-b.x2, 0) <= greatest(1.0, (a.h+b.h)/2)*2.2::DOUBLE))
"""
DUPLICATE = f""", v AS (SELECT *, CAST(x2-x1 AS BIGINT)*(y2-y1) AS area FROM regions WHERE source_text <> ''),
 e AS (SELECT a.page_id, a.region_id AS a, b.region_id AS b FROM v a JOIN v b ON a.page_id = b.page_id AND a.pos < b.pos
   AND (({CROSS} AND ({IOU} > 0.3 OR {INTER}/greatest(least(a.area,b.area),1) > 0.8
        OR (least(a.x2,b.x2)-greatest(a.x1,b.x1))/greatest(least(a.x2-a.x1,b.x2-b.x1),1) > 0.7 OR (least(a.y2,b.y2)-greatest(a.y1,b.y1))/greatest(least(a.y2-a.y1,b.y2-b.y1),1) > 0.7))
     OR sqrt(((a.x1+a.x2-b.x1-b.x2)/2)**2 + ((a.y1+a.y2-b.y1-b.y2)/2)**2) < (sqrt(a.area)+sqrt(b.area))/2*0.5))
"""


def _components(cte: str, nodes: str) -> str:
    return cte + f""", s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 reach AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM reach r JOIN s ON s.a = r.b),
 c AS (SELECT a, min(least(a, b)) AS component FROM reach GROUP BY a)
 SELECT n.region_id, coalesce(component, n.region_id) AS component FROM {nodes} n LEFT JOIN c ON c.a = n.region_id"""


@query("cluster_edges", CLUSTER + "SELECT * FROM e", ("regions",))
def _(t):
    return G.cluster_edges(t.regions, direct=t.direct_profile)


@query("duplicate_edges", DUPLICATE + "SELECT * FROM e", ("regions",))
def _(t):
    return G.duplicate_edges(t.regions, t.direct_profile)


@query("ocr_clusters", _components(CLUSTER, "regions"), ("regions",))
def _(t):
    return G.ocr_clusters(t.regions, profile=pairs(t), direct=t.direct_profile).select("region_id", "component")


@query("connected_components", """SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component
 FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1""")
def _(t):
    """The distributed form, on the chain of every customer's orders by date: the whole order table."""
    from pageloom.operators.graph import connected_components
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = t.orders.select(F.col("o_orderkey").alias("a"), F.lag("o_orderkey").over(by_date).alias("b"))
    return connected_components(edges.where("b is not null"))


LABELLED = _components(DUPLICATE, "v").replace("SELECT n.region_id, coalesce", ", lab AS (SELECT n.*, coalesce", 1) + ")"


@query("cluster_dedup", LABELLED + f""", q AS (SELECT *, CASE WHEN coalesce(confidence, 0) = 0 THEN 0.5 ELSE confidence END*sqrt(area)*ln(length(source_text) + 2.0) AS score, {S.strip('source_text')} AS st FROM lab),
 g AS (SELECT page_id, component, arg_max(struct_pack(region_id := region_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2, source_text := source_text, confidence := confidence), (score, -pos)) AS best,
   list(DISTINCT st) FILTER (st <> '') AS texts, string_agg(source_text, ' ' ORDER BY x1, pos) AS joined, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, avg(confidence) AS confidence, count(*) AS members FROM q GROUP BY 1, 2),
 m AS (SELECT *, members > 1 AND len(texts) > 1 AND len(list_filter(texts, lambda a: len(list_filter(texts, lambda b: a <> b AND contains(b, a))) > 0)) = 0 AS merged FROM g)
 SELECT page_id, best.region_id AS region_id, CASE WHEN merged THEN x1 ELSE best.x1 END AS x1, CASE WHEN merged THEN y1 ELSE best.y1 END AS y1, CASE WHEN merged THEN x2 ELSE best.x2 END AS x2, CASE WHEN merged THEN y2 ELSE best.y2 END AS y2,
   CASE WHEN merged THEN confidence ELSE best.confidence END AS confidence, CASE WHEN merged THEN joined ELSE best.source_text END AS source_text, members, merged FROM m""", ("regions",))
def _(t):
    return G.cluster_dedup(t.regions, pairs(t), t.direct_profile)


# -- first come, first kept ------------------------------------------------------
def _served(order: str, condition: str, where: str, final: str) -> str:
    """Rows served by rank; ``foes`` are the earlier rows in conflict, in rank order."""
    return f""", o AS (SELECT *, length(source_text) AS len, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS rn FROM regions WHERE {where}),
 f AS (SELECT b.page_id, b.rn, list(a.rn ORDER BY a.rn) AS foes FROM o a JOIN o b ON a.page_id = b.page_id AND a.rn < b.rn AND {condition} GROUP BY 1, 2),
 n AS (SELECT o.page_id, o.rn, coalesce(foes, []) AS foes FROM o LEFT JOIN f USING (page_id, rn)),
 s AS (SELECT page_id, 0::BIGINT AS rn, []::BIGINT[] AS kept, NULL::BIGINT AS by_ FROM (SELECT DISTINCT page_id FROM o)
   UNION ALL SELECT s.page_id, n.rn, CASE WHEN list_has_any(s.kept, n.foes) THEN s.kept ELSE list_append(s.kept, n.rn) END,
     list_extract(list_filter(n.foes, lambda x: list_contains(s.kept, x)), 1) FROM s JOIN n ON n.page_id = s.page_id AND n.rn = s.rn + 1),
 d AS (SELECT o.*, s.by_ FROM o JOIN s USING (page_id, rn))
 {final}"""


@query("drop_contained", _served(
    "len DESC, pos", f"{CROSS} AND {INTER}/greatest(least({AREA.format('a')}, {AREA.format('b')}), 1) > 0.5", "source_text <> ''",
    "SELECT region_id FROM d WHERE by_ IS NULL").replace("ORDER BY len DESC", "ORDER BY length(source_text) DESC"), ("regions",))
def _(t):
    return G.drop_contained(t.regions, profile=pairs(t), direct=t.direct_profile).select("region_id")


@query("nms", _served("confidence DESC, y1, pos", f"{CROSS} AND {IOU} > 0.3", "true",
    """, l AS (SELECT k.region_id, arg_max(x.region_id, x.rn) AS shown FROM d x JOIN d k ON k.page_id = x.page_id AND k.rn = x.by_ WHERE k.len > 0 AND x.len > k.len GROUP BY 1)
 SELECT coalesce(shown, d.region_id) AS region_id FROM d LEFT JOIN l ON l.region_id = d.region_id WHERE by_ IS NULL"""), ("regions",))
def _(t):
    """Threshold 0.3 so that the synthetic boxes do collide."""
    return G.nms(t.regions, 0.3, pairs(t), t.direct_profile).select("region_id")


@query("dedup_same_text")
def _(t):
    return G.dedup_same_text(t.regions, 0.05, pairs(t), t.direct_profile).select("page_id", "region_id", "source_text")


# -- grouping --------------------------------------------------------------------
def grouped_input(t):
    return t.regions.withColumns({
        "is_sfx": F.col("source_text").isin("BOOM!", "쾅!"),
        "container_id": F.when(F.col("pos") % 3 == 0, F.col("pos") % 2),
        "is_watermark": F.col("source_text").startswith("NEWTOKI"),
    })


SHARE = "greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1))/greatest(least(a.w,b.w),1)"
GAP, AVG = "(b.y1-a.y2)", "((a.h+b.h)/2)"
HR = "(least(a.h,b.h)/greatest(a.h,b.h,1))"
EXCUSED = f"({HR} < 0.6 AND {HR} >= 0.45 AND {SHARE} >= 0.5 AND {SHARE} >= 0.85 AND {GAP} <= {AVG}*0.85)"
YS = "((least(a.y2,b.y2)-greatest(a.y1,b.y1))/greatest(least(a.h,b.h),1))"
SIDE = "greatest(b.x1-a.x2, a.x1-b.x2, 0)"
GROUPS = f""", r AS (SELECT *, {BUCKET} AS sc, x2-x1 AS w, y2-y1 AS h, source_text IN ('BOOM!', '쾅!') AS sfx, CASE WHEN pos % 3 = 0 THEN pos % 2 END AS cont,
    row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, pos) AS rn FROM regions WHERE source_text <> ''),
 e AS (SELECT b.page_id, b.rn, list(a.rn) AS mates, count(*) AS n FROM r a JOIN r b ON a.page_id = b.page_id AND a.rn < b.rn AND a.sfx = b.sfx
   AND coalesce(a.cont = b.cont, true) AND NOT coalesce(a.sc <> b.sc AND a.sc <> 'mixed' AND b.sc <> 'mixed', false)
   AND ({GAP} <= {AVG}*0.55::DOUBLE OR {EXCUSED}) AND ({HR} >= 0.6 OR {EXCUSED})
   AND ((least(a.w,b.w) > 0 AND {SHARE} >= 0.5) OR (least(a.y2,b.y2) > greatest(a.y1,b.y1) AND (({YS} >= 0.7 AND {SIDE} <= {AVG}*0.8::DOUBLE AND {SHARE} >= 0.5) OR ({YS} >= 0.75 AND {SIDE} <= {AVG}*0.4::DOUBLE)))
     OR abs((a.x1+a.x2-b.x1-b.x2)/2) <= {AVG}*2) GROUP BY 1, 2)
"""


@query("group_edges", GROUPS + "SELECT page_id, rn AS reading_pos, n AS partners FROM e", ("regions",))
def _(t):
    rule = GroupRule(x_overlap_ratio=0.5)
    edges = G.group_edges(grouped_input(t), rule, t.direct_profile)
    from pageloom.skew import ordered, rank
    ranked = ordered(t.regions.where("source_text <> ''"), ["page_id"], ["y1", "x1", "pos"], {"rn": rank()}, t.page_profile)
    n = edges.groupBy("page_id", "b").agg(F.count(F.lit(1)).alias("partners"))
    ranked = ranked.select("page_id", F.col("region_id").alias("b"), "rn")
    return t.page_profile.join(n, ranked, ["b"]).select("page_id", F.col("rn").alias("reading_pos"), "partners")


@query("group_adjacent", GROUPS + """, n AS (SELECT r.page_id, r.rn, coalesce(mates, []) AS mates FROM r LEFT JOIN e USING (page_id, rn)),
 s AS (SELECT page_id, 0::BIGINT AS rn, []::BIGINT[] AS grp FROM (SELECT DISTINCT page_id FROM r)
   UNION ALL SELECT s.page_id, n.rn, list_append(s.grp, coalesce(list_min(list_filter(list_transform(n.mates, lambda m: s.grp[m]), lambda g: len(list_filter(s.grp, lambda x: x = g)) < 4)), n.rn))
   FROM s JOIN n ON n.page_id = s.page_id AND n.rn = s.rn + 1),
 w AS (SELECT page_id, rn, grp[rn] AS g FROM s WHERE rn > 0)
 SELECT r.region_id, k.region_id AS group_id FROM r JOIN w USING (page_id, rn) JOIN r k ON k.page_id = w.page_id AND k.rn = w.g""", ("regions",))
def _(t):
    return G.group_adjacent(grouped_input(t), GroupRule(x_overlap_ratio=0.5), pairs(t), t.direct_profile).select("region_id", "group_id")


@query("merge_group_lines")
def _(t):
    """Whole groups to single lines where they are tight."""
    groups = G.group_adjacent(grouped_input(t), GroupRule(x_overlap_ratio=0.5), pairs(t), t.direct_profile)
    return G.merge_group_lines(groups)


@query("merge_lines_geometric")
def _(t):
    return G.merge_lines_geometric(t.regions, profile=pairs(t))


@query("pair_edge_groups")
def _(t):
    groups = t.lines.withColumn("group_id", F.col("region_id"))
    bottom = G.edge_groups(groups, 1850, "bottom")
    top = G.edge_groups(groups, 1850, "top").withColumn("page_id", F.col("page_id") - 1)
    return G.pair_edge_groups(bottom, top, profile=pairs(t))


@query("pack_by_chars", """, i AS (SELECT page_id, region_id, pos, length(source_text) + CASE WHEN coalesce(target_text, '') <> '' THEN length(target_text) + 18 ELSE 3 END AS size FROM regions),
 s AS (SELECT page_id, 0::BIGINT AS pos, 0 AS batch_no, 0 AS item_no, 0::BIGINT AS chars FROM (SELECT DISTINCT page_id FROM i)
   UNION ALL SELECT page_id, pos, batch_no + closed::INT, CASE WHEN closed THEN 1 ELSE item_no + 1 END, CASE WHEN closed THEN sz ELSE chars + sz END FROM
    (SELECT s.page_id, i.pos, s.batch_no, s.item_no, s.chars, i.size + length((s.item_no + 1)::VARCHAR) AS sz,
       s.item_no > 0 AND (s.item_no >= 12 OR s.chars + i.size + length((s.item_no + 1)::VARCHAR) > 300) AS closed FROM s JOIN i ON i.page_id = s.page_id AND i.pos = s.pos + 1))
 SELECT region_id, batch_no, item_no FROM s JOIN i USING (page_id, pos)""", ("regions",))
def _(t):
    items = t.regions.select("page_id", "region_id", "pos", F.col("source_text").alias("text"), F.col("target_text").alias("context"))
    return G.pack_by_chars(items, 12, 300, profile=pairs(t)).select("region_id", "batch_no", "item_no")
