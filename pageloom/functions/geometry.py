"""Box arithmetic on flat x1, y1, x2, y2 columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.constants import ERASE_ONLY
from pageloom.functions.base import ColumnLike, col
from pageloom.params import FontStyle


class Box:
    """The four columns of a box, with an optional prefix or alias."""

    def __init__(self, prefix: str = "", alias: str = ""):
        name = lambda c: F.col(f"{alias}.{prefix}{c}" if alias else f"{prefix}{c}")
        self.x1, self.y1, self.x2, self.y2 = (name(c) for c in ("x1", "y1", "x2", "y2"))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width.cast("long") * self.height

    @property
    def center_x(self) -> Column:
        """Integer centre, rounded down also for negative values."""
        return F.floor((self.x1 + self.x2) / 2)

    @property
    def center_y(self) -> Column:
        return F.floor((self.y1 + self.y2) / 2)


def overlap_width(a: Box, b: Box) -> Column:
    return F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)


def overlap_height(a: Box, b: Box) -> Column:
    return F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)


def intersects(a: Box, b: Box) -> Column:
    return (overlap_width(a, b) > 0) & (overlap_height(a, b) > 0)


def intersection(a: Box, b: Box) -> Column:
    w, h = overlap_width(a, b), overlap_height(a, b)
    return F.when((w > 0) & (h > 0), w.cast("long") * h).otherwise(F.lit(0).cast("long"))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = a.area + b.area - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def containment(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return intersection(a, b) / F.greatest(F.least(a.area, b.area), F.lit(1))


def x_overlap(a: Box, b: Box) -> Column:
    return overlap_width(a, b) / F.greatest(F.least(a.width, b.width), F.lit(1))


def y_overlap(a: Box, b: Box) -> Column:
    return overlap_height(a, b) / F.greatest(F.least(a.height, b.height), F.lit(1))


def near_edge(box: Box, height: ColumnLike, width: ColumnLike) -> Column:
    """Within the outer tenth of the page."""
    mx, my = col(width) * F.lit(0.1), col(height) * F.lit(0.1)
    return (box.x1 <= mx) | (box.x2 >= col(width) - mx) | (box.y1 <= my) | (box.y2 >= col(height) - my)


def similar_pos(a: Box, b: Box, tolerance: int = 20) -> Column:
    return (F.abs(a.x1 - b.x1) < tolerance) & (F.abs(a.y1 - b.y1) < tolerance)


def band_height(height: ColumnLike, ratio: float = 0.15) -> Column:
    h = col(height)
    want = F.least(F.greatest(F.lit(128), F.floor(h * F.lit(ratio))), F.lit(256))
    return F.when(h <= 0, F.lit(0)).otherwise(F.least(h, want)).cast("long")


def edge_box(box: Box, edge: ColumnLike, height: ColumnLike) -> Column:
    """Box relative to the page border; bottom boxes get negative y."""
    e = col(edge)
    shift = F.when(e == "bottom", col(height)).when(e == "top", F.lit(0))
    return F.when(
        shift.isNotNull(),
        F.struct(
            box.x1.alias("x1"), (box.y1 - shift).alias("y1"),
            box.x2.alias("x2"), (box.y2 - shift).alias("y2"),
        ),
    )


def scale_box(box: Box, sx: ColumnLike, sy: ColumnLike, width: ColumnLike, height: ColumnLike) -> Column:
    """Scaled, half-even rounded and clamped box; null when it vanishes."""
    def place(value: Column, scale: ColumnLike, low: int, high: Column) -> Column:
        v = F.bround(value * col(scale), 0).cast("long")
        return F.greatest(F.lit(low), F.least(v, high))

    w, h = col(width), col(height)
    x1, y1 = place(box.x1, sx, 0, w - 1), place(box.y1, sy, 0, h - 1)
    x2, y2 = place(box.x2, sx, 1, w), place(box.y2, sy, 1, h)
    good = (w > 0) & (h > 0) & (x2 > x1) & (y2 > y1)
    return F.when(
        good, F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    )


def mask_params(box: Box, target: ColumnLike, sfx: ColumnLike, expand: int = 10, dilation: int = 4) -> Column:
    """Struct (expand, dilation), smaller for sound effects and small boxes."""
    small = (box.height <= 18) | (box.width <= 18) | (F.greatest(box.area, F.lit(0)) <= 1200)
    erase_only = F.coalesce(col(target) == ERASE_ONLY, F.lit(False))
    shrink = ~erase_only & (F.coalesce(col(sfx), F.lit(False)) | F.coalesce(small, F.lit(False)))
    return F.struct(
        F.when(shrink, max(4, int(expand * 0.6))).otherwise(max(0, expand)).alias("expand"),
        F.when(shrink, max(2, int(dilation * 0.5))).otherwise(max(0, dilation)).alias("dilation"),
    )


def estimate_font_size(
    box: Box, length: ColumnLike, min_size: int = 12, max_size: int = 48, padding: float = 0.1,
    style: FontStyle = FontStyle(),
) -> Column:
    """Font size that lets ``length`` characters fill the padded box."""
    n = col(length)
    share = 1 - 2 * padding
    w, h = box.width * F.lit(share), box.height * F.lit(share)

    def lines_for(spacing: float) -> Column:
        return F.greatest(F.ceil(F.sqrt(n * h / (w * F.lit(spacing)))), F.lit(1))

    def size_for(spacing: float) -> Column:
        lines = lines_for(spacing)
        by_width = w / F.greatest(F.ceil(n / lines), F.lit(1))
        by_height = h / (lines * F.lit(spacing))
        size = F.least(by_width, by_height) * F.lit(style.bias)
        return F.floor(F.greatest(F.lit(float(min_size)), F.least(F.lit(float(max_size)), size)))

    size = size_for(style.line_spacing)
    if style.compact_spacing is not None and style.compact_threshold:
        tall = lines_for(style.line_spacing) * size * F.lit(style.line_spacing)
        near_limit = tall > h * F.lit(style.compact_threshold)
        size = F.when(near_limit, F.greatest(size, size_for(style.compact_spacing))).otherwise(size)
    fits = (n > 0) & (w > 0) & (h > 0)
    return F.when(fits, size).otherwise(F.lit(min_size)).cast("long")


def font_range(ref: ColumnLike, style: FontStyle = FontStyle()) -> Column:
    """Struct (low, high) of allowed font sizes around a reference size."""
    r = col(ref)
    low = F.greatest(F.lit(style.relax_min), F.bround(r * F.lit(style.ref_range[0]), 0).cast("long"))
    high = F.greatest(low, F.bround(r * F.lit(style.ref_range[1]), 0).cast("long"))
    usable = F.coalesce(r > 0, F.lit(False))
    return F.struct(
        F.when(usable, low).otherwise(F.lit(style.fallback[0])).cast("long").alias("low"),
        F.when(usable, high).otherwise(F.lit(style.fallback[1])).cast("long").alias("high"),
    )


def bounding_box(points: ColumnLike, y_offset: ColumnLike | int = 0) -> Column:
    """Box of a polygon given as ``array<array<double>>``; null below two points."""
    p = col(points)
    dy = F.lit(y_offset) if isinstance(y_offset, int) else col(y_offset)
    xs, ys = F.transform(p, lambda q: q[0]), F.transform(p, lambda q: q[1])
    usable = (F.size(p) >= 2) & F.forall(p, lambda q: F.size(q) >= 2)
    return F.when(
        usable,
        F.struct(
            F.array_min(xs).cast("long").alias("x1"), (F.array_min(ys).cast("long") + dy).alias("y1"),
            F.array_max(xs).cast("long").alias("x2"), (F.array_max(ys).cast("long") + dy).alias("y2"),
        ),
    )


def box_from_list(values: ColumnLike, y_offset: int = 0) -> Column:
    """Box of a flat ``[x1, y1, x2, y2, ...]`` list; null below four numbers."""
    v = col(values)
    at = lambda i: v[i].cast("long")
    return F.when(
        F.size(v) >= 4,
        F.struct(
            at(0).alias("x1"), (at(1) + y_offset).alias("y1"),
            at(2).alias("x2"), (at(3) + y_offset).alias("y2"),
        ),
    )
