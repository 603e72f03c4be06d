"""Column functions: geometry of boxes and polygons, vectors, and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(c: Column, digits: int) -> Column:
    """Rounds as analytical databases do on doubles: scaled, rounded to an integer, scaled back."""
    scale = float(10**digits)
    return F.round(c.cast("double") * scale, 0) / F.lit(scale)


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def foot_point(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), b["y2"].alias("y"))


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes over their union; 0 where the union has no area."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def quality_ok(b: Column, frame_w: float, frame_h: float, min_height: float = 32.0, margin: float = 2.0, max_aspect: float = 1.2) -> Column:
    """Crops worth embedding: tall enough, not cut off by the frame, upright."""
    tall = height(b) >= min_height
    inside = (b["x1"] > margin) & (b["y1"] > margin) & (b["x2"] < frame_w - margin) & (b["y2"] < frame_h - margin)
    return tall & inside & (width(b) / F.greatest(height(b), F.lit(1e-6)) <= max_aspect)


def polygon_edges(points: Column) -> Column:
    """The edges (ax, ay, bx, by) of a polygon, an array of (x, y) structs."""
    nxt = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    return F.zip_with(points, nxt, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def edges_contain(edges: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies in or on the polygon of these edges."""

    def on_edge(e):
        cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        return (cross == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    def crossed(e):
        spans = (e["ay"] > y) != (e["by"] > y)
        return F.when(spans, x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]).otherwise(False)

    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crossed)) % 2 == 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalise(a: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9))
    return F.transform(a, lambda x: x.cast("double") / norm)


def to_measure(b: Column) -> Column:
    """Centre, area and aspect of a box, as motion filters take it."""
    w, h = F.greatest(b["x2"] - b["x1"], F.lit(1e-6)), F.greatest(b["y2"] - b["y1"], F.lit(1e-6))
    return F.struct((b["x1"] + w / 2).alias("cx"), (b["y1"] + h / 2).alias("cy"), (w * h).alias("s"), (w / h).alias("r"))


def clip_box(b: Column, frame_w: float, frame_h: float) -> Column:
    """The part of a box inside the frame, in whole pixels; null where none is left."""
    at = lambda c, hi: F.greatest(F.lit(0.0), F.least(c, F.lit(hi))).cast("int")
    x1, y1, x2, y2 = at(b["x1"], frame_w), at(b["y1"], frame_h), at(b["x2"], frame_w), at(b["y2"], frame_h)
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def role_by_colour(colour: Column, uniform: list[int], reach: int = 40) -> Column:
    """Role and confidence by the distance of a median colour (three channels) from the uniform's; null: unknown."""
    d = sum(F.abs(colour[n].cast("double") - float(u)) for n, u in enumerate(uniform))
    staff = F.struct(F.lit("employee").alias("role"), (1 - d / 765.0).alias("confidence"))
    other = F.struct(F.lit("customer").alias("role"), F.least(F.lit(1.0), d / 765.0 + 0.5).alias("confidence"))
    return F.when(d.isNull(), F.struct(F.lit("unknown").alias("role"), F.lit(0.0).alias("confidence"))).when(d <= reach, staff).otherwise(other)


def from_measure(m: Column) -> Column:
    """The box of a measure (cx, cy, s, r): the inverse of ``to_measure``."""
    w = F.sqrt(F.greatest(m["s"] * m["r"], F.lit(1e-6)))
    h = m["s"] / F.greatest(w, F.lit(1e-6))
    return F.struct((m["cx"] - w / 2).alias("x1"), (m["cy"] - h / 2).alias("y1"), (m["cx"] + w / 2).alias("x2"), (m["cy"] + h / 2).alias("y2"))


def letterbox(b: Column, frame_w: float, frame_h: float, size: float) -> Column:
    """A frame's box as (cx, cy, w, h) in a square of ``size`` whose upper left corner the frame, fitted, starts from."""
    k = F.lit(size / max(frame_w, frame_h))
    return F.struct(((b["x1"] + b["x2"]) / 2 * k).alias("cx"), ((b["y1"] + b["y2"]) / 2 * k).alias("cy"), ((b["x2"] - b["x1"]) * k).alias("w"), ((b["y2"] - b["y1"]) * k).alias("h"))


def unletterbox(c: Column, frame_w: float, frame_h: float, size: float) -> Column:
    """The frame's box of (cx, cy, w, h) in the square, clipped to the frame."""
    k = F.lit(size / max(frame_w, frame_h))
    at = lambda v, hi: F.greatest(F.lit(0.0), F.least(v / k, F.lit(float(hi))))
    x, y, w, h = c["cx"], c["cy"], c["w"] / 2, c["h"] / 2
    return F.struct(at(x - w, frame_w).alias("x1"), at(y - h, frame_h).alias("y1"), at(x + w, frame_w).alias("x2"), at(y + h, frame_h).alias("y2"))


def stride(native_fps: float | None, target_fps: float) -> int:
    """Each how many frames of a source are taken; a source that names no rate counts as 25 frames a second."""
    return max(1, round((native_fps or 25.0) / target_fps))
