"""Box functions over every region."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from pageloom.functions import geometry as G
from pageloom.operators.joins import next_on_page
from pageloom.params import FontStyle

PAIR = """, pairs AS (SELECT a.region_id, a.x1, a.y1, a.x2, a.y2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
  FROM lines a JOIN lines b ON a.page_id = b.page_id AND b.pos = a.pos + 1),
 m AS (SELECT *, least(x2, bx2) - greatest(x1, bx1) AS iw, least(y2, by2) - greatest(y1, by1) AS ih,
   CAST(x2-x1 AS BIGINT)*(y2-y1) AS area, CAST(bx2-bx1 AS BIGINT)*(by2-by1) AS barea FROM pairs),
 n AS (SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN CAST(iw AS BIGINT)*ih ELSE 0 END AS inter FROM m)
"""


@query("box_measures", """SELECT region_id, x2-x1 AS width, y2-y1 AS height, CAST(floor((x1+x2)/2) AS BIGINT) AS center_x,
  CAST(floor((y1+y2)/2) AS BIGINT) AS center_y, CAST(x2-x1 AS BIGINT)*(y2-y1) AS area FROM lines""", ("lines",))
def _(t):
    b = G.Box()
    return t.lines.select(
        "region_id", b.width.alias("width"), b.height.alias("height"), b.center_x.alias("center_x"),
        b.center_y.alias("center_y"), b.area.alias("area"),
    )


@query("box_overlap", PAIR + """SELECT region_id,
  CASE WHEN inter > 0 THEN CAST(inter AS DOUBLE)/(area+barea-inter) ELSE 0.0::DOUBLE END AS iou,
  CAST(inter AS DOUBLE)/greatest(least(area, barea), 1) AS containment,
  CAST(iw AS DOUBLE)/greatest(least(x2-x1, bx2-bx1), 1) AS x_overlap,
  CAST(ih AS DOUBLE)/greatest(least(y2-y1, by2-by1), 1) AS y_overlap,
  abs(x1-bx1) < 20 AND abs(y1-by1) < 20 AS similar_pos FROM n""", ("lines",))
def _(t):
    """Each region against the next detected one of its page."""
    df = next_on_page(t.lines, ["x1", "y1", "x2", "y2"], t.page_profile)
    a, b = G.Box(), G.Box("next_")
    return df.where("next_x1 IS NOT NULL").select(
        "region_id", G.iou(a, b).alias("iou"), G.containment(a, b).alias("containment"),
        G.x_overlap(a, b).alias("x_overlap"), G.y_overlap(a, b).alias("y_overlap"),
        G.similar_pos(a, b).alias("similar_pos"),
    )


@query("page_position", """SELECT region_id, x1 <= 80 OR x2 >= 720 OR y1 <= 200 OR y2 >= 1800 AS near_edge,
  CAST(CASE WHEN h <= 0 THEN 0 ELSE least(h, least(greatest(128, floor(h*0.15)), 256)) END AS BIGINT) AS band,
  CAST(CASE WHEN h <= 0 THEN 0 ELSE least(h, least(greatest(128, floor(h*0.12)), 256)) END AS BIGINT) AS narrow_band,
  x1 AS ex1, CASE WHEN bottom THEN y1 - 2000 ELSE y1 END AS ey1, x2 AS ex2, CASE WHEN bottom THEN y2 - 2000 ELSE y2 END AS ey2
  FROM (SELECT *, y2 AS h, y1 >= 1000 AS bottom FROM lines)""", ("lines",))
def _(t):
    b = G.Box()
    edge = F.when(b.y1 >= 1000, "bottom").otherwise("top")
    return t.lines.select(
        "region_id", G.near_edge(b, F.lit(2000), F.lit(800)).alias("near_edge"),
        G.band_height("y2").alias("band"), G.band_height("y2", 0.12).alias("narrow_band"),
        G.edge_box(b, edge, F.lit(2000)).alias("e"),
    ).select("region_id", "near_edge", "band", "narrow_band", F.col("e.x1").alias("ex1"),
             F.col("e.y1").alias("ey1"), F.col("e.x2").alias("ex2"), F.col("e.y2").alias("ey2"))


@query("scale_box", """, s AS (SELECT region_id, greatest(0, least(CAST(round_even(x1*1.5, 0) AS BIGINT), 899)) AS sx1,
   greatest(0, least(CAST(round_even(y1*0.75, 0) AS BIGINT), 1199)) AS sy1,
   greatest(1, least(CAST(round_even(x2*1.5, 0) AS BIGINT), 900)) AS sx2,
   greatest(1, least(CAST(round_even(y2*0.75, 0) AS BIGINT), 1200)) AS sy2 FROM lines)
 SELECT region_id, CASE WHEN sx2 > sx1 AND sy2 > sy1 THEN sx1 END AS sx1, CASE WHEN sx2 > sx1 AND sy2 > sy1 THEN sy1 END AS sy1,
   CASE WHEN sx2 > sx1 AND sy2 > sy1 THEN sx2 END AS sx2, CASE WHEN sx2 > sx1 AND sy2 > sy1 THEN sy2 END AS sy2 FROM s""", ("lines",))
def _(t):
    s = G.scale_box(G.Box(), F.lit(1.5), F.lit(0.75), F.lit(900), F.lit(1200))
    return t.lines.select("region_id", s.alias("s")).select(
        "region_id", *[F.col(f"s.{c}").cast("long").alias(f"s{c}") for c in ("x1", "y1", "x2", "y2")]
    )


@query("remap_boxes", """SELECT region_id, x1, CAST(y1 + tile_y AS INT) AS y1, x2, CAST(y2 + tile_y AS INT) AS y2
  FROM (SELECT *, (pos % 3) * 512 AS tile_y FROM lines)""", ("lines",))
def _(t):
    from pageloom.operators.joins import remap_to_page
    tiles = t.lines.select("page_id", (F.col("pos") % 3).alias("tile")).distinct().withColumns(
        {"x_offset": F.lit(0), "y_offset": F.col("tile") * 512}
    )
    local = t.lines.withColumn("tile", F.col("pos") % 3)
    return remap_to_page(local, tiles, ["page_id", "tile"]).select("region_id", "x1", "y1", "x2", "y2")


@query("mask_params", """, k AS (SELECT region_id, target_text, x2-x1 AS w, y2-y1 AS h, region_id % 5 = 0 AS sfx FROM regions)
 SELECT region_id, CASE WHEN s THEN 6 ELSE 10 END AS expand, CASE WHEN s THEN 2 ELSE 4 END AS dilation
 FROM (SELECT *, coalesce(target_text, '') <> '[INPAINT_ONLY]' AND (sfx OR h <= 18 OR w <= 18 OR w*h <= 1200) AS s FROM k)""", ("regions",))
def _(t):
    m = G.mask_params(G.Box(), "target_text", F.col("region_id") % 5 == 0)
    return t.regions.select("region_id", m.alias("m")).select("region_id", "m.*")


def _font_sql(spacing: float, bias: float) -> str:
    lines = f"greatest(ceil(sqrt(n*h/(w*{spacing}::DOUBLE))), 1)"
    return (
        f"floor(greatest(12.0, least(48.0, {bias}::DOUBLE * least(w/greatest(ceil(n/{lines}), 1), h/({lines}*{spacing}::DOUBLE)))))"
    )


@query("estimate_font_size", f""", k AS (SELECT region_id, length(source_text) AS n, (x2-x1)*0.8::DOUBLE AS w, (y2-y1)*0.8::DOUBLE AS h FROM regions),
 z AS (SELECT *, {_font_sql(1.2, 1.2)} AS size, {_font_sql(1.1, 1.2)} AS tight, greatest(ceil(sqrt(n*h/(w*1.2::DOUBLE))), 1) AS rows_needed FROM k)
 SELECT region_id, CAST(CASE WHEN n = 0 OR w <= 0 OR h <= 0 THEN 12
   WHEN rows_needed*size*1.2::DOUBLE > h*0.9::DOUBLE THEN greatest(size, tight) ELSE size END AS BIGINT) AS size FROM z""", ("regions",))
def _(t):
    size = G.estimate_font_size(G.Box(), F.length("source_text"), style=FontStyle(bias=1.2))
    return t.regions.select("region_id", size.alias("size"))


@query("font_range", """SELECT region_id, CAST(CASE WHEN r > 0 THEN greatest(14, round_even(r*0.9, 0)) ELSE 18 END AS BIGINT) AS low,
  CAST(CASE WHEN r > 0 THEN greatest(greatest(14, round_even(r*0.9, 0)), round_even(r*1.2, 0)) ELSE 36 END AS BIGINT) AS high
  FROM (SELECT region_id, (y2-y1) - 13 AS r FROM lines)""", ("lines",))
def _(t):
    style = FontStyle(ref_range=(0.9, 1.2), fallback=(18, 36), relax_min=14, bias=1.2)
    r = F.col("y2") - F.col("y1") - 13
    return t.lines.select("region_id", G.font_range(r, style).alias("r")).select("region_id", "r.*")


@query("rows_touching_border", """SELECT page_id, bool_or(y1 <= 8 OR y2 >= 1992 - 180) AS touches FROM lines GROUP BY page_id""", ("lines",))
def _(t):
    from pageloom.operators.reports import touches_border
    return touches_border(t.lines, 2000 - 180, 8)


@query("bounding_box", """SELECT region_id, CAST(x1 AS BIGINT) AS bx1, CAST(y1 + 100 AS BIGINT) AS by1, CAST(x2 AS BIGINT) AS bx2, CAST(y2 + 100 AS BIGINT) AS by2 FROM lines""", ("lines",))
def _(t):
    d = lambda c: F.col(c).cast("double")
    points = F.array(F.array(d("x2"), d("y1")), F.array(d("x1"), d("y2")), F.array(d("x1") + 0.5, d("y1")))
    flat = F.array(d("x1"), d("y1"), d("x2"), d("y2"))
    box = F.coalesce(F.when(F.col("pos") % 2 == 0, G.bounding_box(points, 100)), G.box_from_list(flat, 100))
    return t.lines.select("region_id", box.alias("b")).select(
        "region_id", *[F.col(f"b.{c}").alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")]
    )
