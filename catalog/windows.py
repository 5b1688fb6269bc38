"""Ordered, generating and merging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.registry import query
from pageloom.constants import WATERMARK_KEYWORDS
from pageloom.operators import merging as M
from pageloom.operators import ordering as O
from pageloom.operators import windows as W
from pageloom.params import TileRule
from pageloom.plans.views import add_hierarchy, epoch_micros

KEY = "regexp_replace(lower(source_text), '(" + S.WS + "|[-._:·•])+', '', 'g')"
WORDS = " OR ".join(f"contains(lower(source_text), '{k}') OR contains({KEY}, '{k}')" for k in WATERMARK_KEYWORDS)


def _mark_sql(scope: str, order: str) -> str:
    return f""", k AS (SELECT *, CAST(floor(page_id/12) AS BIGINT) AS chapter_id, CASE WHEN {KEY} <> '' THEN {KEY} ELSE lower(source_text) END AS key, ({WORDS}) AS word FROM regions),
  l AS (SELECT *, lag(x1) OVER w AS px, lag(y1) OVER w AS py FROM k WINDOW w AS (PARTITION BY {scope}, key ORDER BY {order}))
 SELECT region_id, word OR coalesce(abs(x1-px) < 20 AND abs(y1-py) < 20, false) OR {S.has('key', '^[a-z0-9]{4,}(com|net|org)$')}
   OR ((x1 <= 80 OR x2 >= 720 OR y1 <= 200 OR y2 >= 1800) AND {S.has('key', '^[^\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\p{Z}]{2,12}\\p{Nd}{1,4}$')}) AS is_watermark,
   CASE WHEN word THEN 'keyword' WHEN coalesce(abs(x1-px) < 20 AND abs(y1-py) < 20, false) THEN 'repeat' WHEN {S.has('key', '^[a-z0-9]{4,}(com|net|org)$')} THEN 'domain'
    WHEN (x1 <= 80 OR x2 >= 720 OR y1 <= 200 OR y2 >= 1800) AND {S.has('key', '^[^\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\p{Z}]{2,12}\\p{Nd}{1,4}$')} THEN 'edge' END AS watermark_rule FROM l"""


@query("watermark_flag", _mark_sql("page_id", "pos"), ("regions",))
def _(t):
    return W.watermark_flag(t.regions, 2000, 800, profile=t.page_profile).select("region_id", "is_watermark", "watermark_rule")


@query("watermark_flag_chapter", _mark_sql("chapter_id", "page_id, pos"), ("regions",))
def _(t):
    df = add_hierarchy(t.regions)
    profile = t.profile("chapters", add_hierarchy(t._paged_lines), ["chapter_id"])
    return W.watermark_flag(df, 2000, 800, ["chapter_id"], profile=profile, order=["page_id", "pos", "region_id"]).select(
        "region_id", "is_watermark", "watermark_rule"
    )


@query("neighbour_context", """, g AS (SELECT page_id, pos AS group_no, source_text AS text, CASE WHEN confidence >= 0.4 AND source_text <> '' THEN source_text END AS shown FROM regions),
 c AS (SELECT page_id, group_no, concat_ws(' | ', lag(shown) OVER w, lead(shown) OVER w) AS context FROM g WINDOW w AS (PARTITION BY page_id ORDER BY group_no))
 SELECT page_id, group_no, CASE WHEN length(context) <= 20 THEN context ELSE substr(context, 1, 17) || '...' END AS context FROM c""", ("regions",))
def _(t):
    groups = t.regions.select("page_id", F.col("pos").alias("group_no"), F.col("source_text").alias("text"), (F.col("confidence") >= 0.4).alias("eligible"))
    return W.neighbour_context(groups, 20, t.page_profile).select("page_id", "group_no", "context")


def heights(t):
    """Every order as a page of its own height."""
    return t.orders.select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") * 41 % 70000 + 1).alias("height"))


HEIGHTS = "WITH RECURSIVE h AS (SELECT o_orderkey AS page, o_custkey*41 % 70000 + 1 AS height FROM orders), "


def _span_sql(name: str, first: str, nxt: str) -> str:
    return HEIGHTS + f"""s AS (SELECT page, height, 0::BIGINT AS "index", {first} FROM h
   UNION ALL SELECT page, height, "index" + 1, {nxt} FROM s WHERE "end" < height) SELECT page, height, "index", "start", "end" FROM s"""


@query("tiles", HEIGHTS + """s AS (SELECT page, height, 0::BIGINT AS "index", 0::BIGINT AS y, 0::BIGINT AS "start",
     CASE WHEN height <= 1536 THEN height ELSE least(height, 1024 + 64 + CASE WHEN height - 1024 < 256 THEN height - 1024 ELSE 0 END) END AS "end" FROM h
   UNION ALL SELECT page, height, "index" + 1, y + 768, greatest(0, y + 768 - 64),
     least(height, 64 + CASE WHEN height - least(y + 768 + 1024, height) < 256 THEN height ELSE least(y + 768 + 1024, height) END) FROM s WHERE "end" < height)
 SELECT page, height, "index", "start", "end" FROM s""")
def _(t):
    return W.tiles(heights(t), "height", TileRule(overlap_ratio=0.25))


@query("edge_tiles", """WITH h AS (SELECT o_orderkey AS page, o_custkey*41 % 70000 + 1 AS height FROM orders),
 b AS (SELECT *, least(greatest(CAST(floor(height*0.15) AS BIGINT), 128), height) AS band FROM h)
 SELECT page, height, 0::BIGINT AS "index", 0::BIGINT AS "start", least(height, band + 64) AS "end" FROM b
 UNION ALL SELECT page, height, 1, greatest(0, height - band - 64), height FROM b""")
def _(t):
    return W.edge_tiles(heights(t))


@query("slices", _span_sql("slices", '0::BIGINT AS "start", CASE WHEN height <= 16383 OR height - 16000 <= 32 THEN height ELSE 16000 END AS "end"',
       '"start" + 15968, CASE WHEN height - ("start" + 15968 + 16000) <= 32 THEN height ELSE "start" + 15968 + 16000 END'))
def _(t):
    return W.slices(heights(t))


@query("stripes", _span_sql("stripes", '0::BIGINT AS "start", CASE WHEN height <= 3000 OR height - 2000 < 64 THEN height ELSE 2000 END AS "end"',
       '"start" + 1936, CASE WHEN height - ("start" + 1936 + 2000) < 64 THEN height ELSE "start" + 1936 + 2000 END'))
def _(t):
    return W.stripes(heights(t), 2000, 64, 3000)


@query("stripe_layout", HEIGHTS + """s AS (SELECT page, height, 0::BIGINT AS i, 0::BIGINT AS s, CASE WHEN height <= 3000 OR height - 2000 < 64 THEN height ELSE 2000 END AS e FROM h
   UNION ALL SELECT page, height, i + 1, s + 1936, CASE WHEN height - (s + 1936 + 2000) < 64 THEN height ELSE s + 1936 + 2000 END FROM s WHERE e < height),
 k AS (SELECT page, i AS "index", CASE WHEN i = 0 THEN 0 ELSE 64 END AS keep_from, (e - s)*2 - CASE WHEN e < height THEN 64 ELSE 0 END AS keep_to FROM s)
 SELECT page, "index", CAST(keep_from AS BIGINT) AS keep_from, CAST(keep_to AS BIGINT) AS keep_to,
   CAST(coalesce(sum(keep_to - keep_from) OVER (PARTITION BY page ORDER BY "index" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM k""")
def _(t):
    spans = W.stripes(heights(t), 2000, 64, 3000)
    return W.stripe_layout(spans, ["page"], 64, 2).select("page", "index", "keep_from", "keep_to", "offset")


@query("pack_by_count", """SELECT region_id, CAST(floor((pos-1)/12) AS BIGINT) AS batch_no, (pos-1) % 12 + 1 AS item_no FROM lines""", ("lines",))
def _(t):
    return W.pack_by_count(t.lines, ["page_id"], ["pos"], 12, t.page_profile).select("region_id", "batch_no", "item_no")


@query("recent_history", """, v AS (SELECT chapter_id, task_id, max(ts) AS ts FROM progress GROUP BY 1, 2)
 SELECT chapter_id, task_id FROM v ORDER BY ts DESC LIMIT 50""", ("progress",))
def _(t):
    return W.recent_history(t.progress, 50, ["chapter_id", "task_id"], "ts", "event_id").select("chapter_id", "task_id")


@query("pace_audit", """, r AS (SELECT event_id, chapter_id, epoch_us(ts)/1e6 AS t0, row_number() OVER (PARTITION BY chapter_id ORDER BY ts, event_id) - 1 AS i FROM progress),
 m AS (SELECT *, max(t0 - i*600.0::DOUBLE) OVER (PARTITION BY chapter_id ORDER BY t0, event_id) + i*600.0::DOUBLE AS allowed_at FROM r)
 SELECT event_id, round(allowed_at, 3) AS allowed_at, round(greatest(0.0, allowed_at - t0), 3) AS too_early FROM m""", ("progress",))
def _(t):
    r = t.progress.select("event_id", "chapter_id", (epoch_micros("ts") / F.lit(1e6)).alias("at"))
    out = W.pace_audit(r, 1 / 600, ["chapter_id"], "at", "event_id", t.profile("progress", r, ["chapter_id"]))
    return out.select("event_id", F.round("allowed_at", 3).alias("allowed_at"), F.round("too_early", 3).alias("too_early"))


@query("largest_in_group", """, g AS (SELECT *, pos // 3 AS grp, pos % 5 = 0 AS skipped, pos % 7 = 0 AS blank, CAST(x2-x1 AS BIGINT)*(y2-y1) AS area FROM lines),
 w AS (SELECT *, count(*) OVER p AS n, count(*) FILTER (NOT skipped) OVER p AS okn, row_number() OVER (PARTITION BY page_id, grp ORDER BY skipped, area DESC, pos) AS rn,
   min(x1) OVER p AS ux1, max(y2) OVER p AS uy2 FROM g WINDOW p AS (PARTITION BY page_id, grp))
 SELECT region_id, CASE WHEN n = 1 THEN 'r' || region_id WHEN okn = 0 THEN '' WHEN rn = 1 THEN 'r' || region_id WHEN blank THEN '' ELSE '[INPAINT_ONLY]' END AS target_text,
   CASE WHEN n > 1 AND okn > 0 AND rn = 1 THEN ux1 END AS render_x1, CASE WHEN n > 1 AND okn > 0 AND rn = 1 THEN uy2 END AS render_y2 FROM w""", ("lines",))
def _(t):
    df = t.lines.withColumns({
        "grp": F.floor(F.col("pos") / 3), "skipped": F.col("pos") % 5 == 0, "blank": F.col("pos") % 7 == 0,
        "reply": F.concat(F.lit("r"), F.col("region_id").cast("string")),
    })
    return W.largest_in_group(df, ["page_id", "grp"]).select("region_id", "target_text", "render_x1", "render_y2")


@query("retry_budget", """SELECT page_id, region_id, retry_no FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS retry_no
   FROM regions WHERE starts_with(coalesce(target_text, ''), '[翻译失败]')) WHERE retry_no <= 4""", ("regions",))
def _(t):
    from pageloom.functions.script import is_failure
    return W.retry_budget(t.regions, is_failure("target_text"), 4).select("page_id", "region_id", "retry_no")


@query("newest_per_listener", """SELECT event_id, task_id, age FROM (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS INT) AS age FROM progress) WHERE age <= 5""", ("progress",))
def _(t):
    return W.newest_per_listener(t.progress, 5, "task_id", "ts", "event_id").select("event_id", "task_id", "age")


@query("stage_index", """SELECT event_id, CASE stage WHEN 'ocr' THEN 1 WHEN 'translator' THEN 2 WHEN 'renderer' THEN 4 ELSE 6 END AS stage_index FROM progress""", ("progress",))
def _(t):
    return t.progress.select("event_id", W.stage_index(F.col("stage")).alias("stage_index"))


@query("dedupe_keep_order", """SELECT source_text, arg_min(region_id, region_id) AS region_id FROM regions GROUP BY 1""", ("regions",))
def _(t):
    return W.dedupe_keep_order(t.regions, ["source_text"], ["region_id"], ["region_id"])


@query("reading_order", """SELECT region_id, row_number() OVER (PARTITION BY page_id ORDER BY floor(y1/20), x1, pos) AS reading_rank FROM lines""", ("lines",))
def _(t):
    return O.reading_order(t.lines, t.page_profile).select("region_id", "reading_rank")


@query("merge_paragraphs", """, l AS (SELECT *, lag(x1) OVER w AS lx1, lag(y1) OVER w AS ly1, lag(x2) OVER w AS lx2, lag(y2) OVER w AS ly2 FROM regions WINDOW w AS (PARTITION BY page_id ORDER BY y1, x1, pos)),
 f AS (SELECT *, CASE WHEN y1 - ly2 < ((ly2-ly1) + (y2-y1))/2*3.0 AND y1 - ly2 > -((ly2-ly1) + (y2-y1))/2*0.5
    AND greatest(0, least(x2, lx2) - greatest(x1, lx1))/greatest(least(x2-x1, lx2-lx1), 1) > 0.15 THEN 0 ELSE 1 END AS brk FROM l),
 g AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY page_id ORDER BY y1, x1, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM f)
 SELECT page_id, paragraph, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg(confidence), 6) AS confidence, count(*) AS members, min(region_id) AS first_id,
   coalesce(string_agg(source_text, ' ' ORDER BY x1, y1, pos) FILTER (source_text <> ''), '') AS source_text FROM g GROUP BY 1, 2""", ("regions",))
def _(t):
    out = M.merge_paragraphs(t.regions, profile=t.page_profile)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("merge_to_chunks", """, l AS (SELECT *, max(y2) OVER (PARTITION BY page_id ORDER BY y1, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM lines),
 g AS (SELECT *, sum(CASE WHEN y1 - pe < 40 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY y1, pos ROWS UNBOUNDED PRECEDING) AS isl FROM l),
 i AS (SELECT page_id, min(y1) AS top, max(y2) AS bottom, min(x1) AS x1, max(x2) AS x2 FROM g GROUP BY page_id, isl)
 SELECT page_id, CAST(y AS INT) AS y1, CASE WHEN bottom - top > 300 THEN least(CAST(y AS INT) + 300, bottom) ELSE bottom END AS y2, x1, x2
 FROM i, unnest(CASE WHEN bottom - top > 300 THEN range(top, bottom, 200) ELSE [top] END) AS u(y)""", ("lines",))
def _(t):
    return M.merge_to_chunks(t.lines, 40, 300, t.page_profile)


@query("vertical_gap_fill", """, k AS (SELECT page_id, pos, CASE WHEN coalesce(target_text, '') <> '[INPAINT_ONLY]' AND (y2-y1 <= 18 OR x2-x1 <= 18 OR (x2-x1)*(y2-y1) <= 1200) THEN 6 ELSE 10 END AS g, x1, y1, x2, y2 FROM regions),
 e AS (SELECT page_id, pos, greatest(0, x1-g) AS x1, greatest(0, y1-g) AS y1, least(800, x2+g) AS x2, least(2000, y2+g) AS y2 FROM k),
 l AS (SELECT *, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2 FROM e WINDOW w AS (PARTITION BY page_id ORDER BY y1, pos))
 SELECT page_id, pos, greatest(0, least(x1, nx1) - 10) AS fill_x1, y2 AS fill_y1, least(800, greatest(x2, nx2) + 10) AS fill_x2, ny1 AS fill_y2 FROM l
 WHERE ny1 - y2 > 0 AND ny1 - y2 < 80 AND least(x2, nx2) - greatest(x1, nx1) > least(x2-x1, nx2-nx1)*0.5""", ("regions",))
def _(t):
    return M.vertical_gap_fill(t.regions.withColumn("is_sfx", F.lit(False)), 2000, 800, 80, profile=t.page_profile)


@query("merge_same_line")
def _(t):
    return M.merge_same_line(t.regions, profile=t.page_profile)


def _groups(t):
    return t.lines.withColumns({"group_id": F.floor(F.col("pos") / 4), "edge_role": F.when(F.col("pos") % 40 == 0, "current_top")})


@query("line_count")
def _(t):
    return M.group_facts(_groups(t), ["page_id", "group_id"]).select("page_id", "group_id", "lines", F.round("confidence", 6).alias("confidence"))


@query("second_reading_requests")
def _(t):
    keys = ["page_id", "group_id"]
    return M.second_reading_requests(M.needs_second_reading(M.group_facts(_groups(t), keys), 2000), keys)


@query("rescan_flag", """SELECT page_id, count(r.region_id) < 4 OR coalesce(round(avg(confidence), 9), 0.5) < 0.5 AS rescan
  FROM page_facts LEFT JOIN lines r USING (page_id) GROUP BY page_id""", ("lines", "page_facts"))
def _(t):
    return M.rescan_flag(t.page_facts, t.lines, 4, 0.5)
