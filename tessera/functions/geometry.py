"""Boxes as structs (x1, y1, x2, y2 of double), alone or in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Side of the square space that proposals live in.
SIDE = 336.0
CORNERS = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for v, n in zip((x1, y1, x2, y2), CORNERS)))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def from_center(cx: Column, cy: Column, w: Column, h: Column, side: float = SIDE) -> Column:
    return box((cx - w / 2) * side, (cy - h / 2) * side, (cx + w / 2) * side, (cy + h / 2) * side)


def big_enough(w: Column, h: Column, least: float = 10.0) -> Column:
    """Both sides; fractional proposals use a least of 0.05."""
    return (w >= least) & (h >= least)


def proper(b: Column) -> Column:
    return (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def to_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, need_size: bool = True) -> Column:
    """xywh -> box; fractions (nothing above 1) are scaled by the image."""
    fractional = F.greatest(x, y, w, h) <= 1.0
    if need_size:
        fractional = fractional & (width > 0) & (height > 0)
    return F.when(fractional, box(x * width, y * height, (x + w) * width, (y + h) * height)).otherwise(from_xywh(x, y, w, h))


def full_frame(width: Column, height: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(box(zero, zero, width, height))


def or_full_frame(boxes: Column, width: Column, height: Column) -> Column:
    return F.when((F.size(boxes) == 0) & (width > 0) & (height > 0), full_frame(width, height)).otherwise(boxes)


def area(b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b["x2"] - b["x1"]) * F.greatest(zero, b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(zero, w) * F.greatest(zero, h)


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def signed_area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def cap_boxes(boxes: Column, most: int | None) -> Column:
    """At most ``most`` boxes: the largest, larger first and earlier first on ties; fewer stay in their order."""
    if most is None:
        return boxes
    keyed = F.array_sort(F.transform(boxes, lambda b, i: F.struct((-signed_area(b)).alias("a"), i.alias("i"), b.alias("b"))))
    return F.when(F.size(boxes) > most, F.transform(F.slice(keyed, 1, most), lambda k: k["b"])).otherwise(boxes)


def clamp_scale(b: Column, width: Column, height: Column, side: float = SIDE) -> Column:
    """Pixel box clamped to the image and scaled to ``side``; the far corner is at least one pixel on, even past the edge."""
    zero, one = F.lit(0.0), F.lit(1.0)
    x1 = F.greatest(zero, F.least(b["x1"], width - one))
    y1 = F.greatest(zero, F.least(b["y1"], height - one))
    x2 = F.greatest(x1 + one, F.least(b["x2"], width))
    y2 = F.greatest(y1 + one, F.least(b["y2"], height))
    return box(x1 * side / width, y1 * side / height, x2 * side / width, y2 * side / height)


def to_unit(b: Column, side: float = SIDE) -> Column:
    return box(*(b[c] / side for c in CORNERS))


def unscale(b: Column, width: Column, height: Column, side: float = SIDE) -> Column:
    return box(b["x1"] * width / side, b["y1"] * height / side, b["x2"] * width / side, b["y2"] * height / side)


def _by_score(proposals: Column) -> Column:
    """Structs (score, box, label) in order of score, earlier first on ties."""
    keyed = F.array_sort(F.transform(proposals, lambda p, i: F.struct((-p["score"]).alias("s"), i.alias("i"), p.alias("p"))))
    return F.transform(keyed, lambda k: k["p"])


def suppress(proposals: Column, schema: str, limit: float = 0.95) -> Column:
    """Greedy suppression by score: a proposal goes if its IoU with a kept one exceeds ``limit``."""
    start = F.array().cast(f"array<{schema}>")
    return F.aggregate(_by_score(proposals), start, lambda kept, p: F.when(F.exists(kept, lambda k: iou(k["box"], p["box"]) > limit), kept).otherwise(F.concat(kept, F.array(p))))


def drop_contained(proposals: Column, schema: str, overlap: float = 0.85, most: float = 0.5) -> Column:
    """By score: empty boxes go, and boxes that lie mostly inside a kept box of at least twice their area."""
    start = F.array().cast(f"array<{schema}>")

    def inside(k: Column, p: Column) -> Column:
        inner, outer = area(p["box"]), area(k["box"])
        return (intersection(k["box"], p["box"]) / inner >= overlap) & (inner < outer) & (inner / outer <= most)

    return F.aggregate(_by_score(proposals), start, lambda kept, p: F.when((area(p["box"]) <= 0) | F.exists(kept, lambda k: inside(k, p)), kept).otherwise(F.concat(kept, F.array(p))))


def whole_image() -> Column:
    """What stands for an image in which nothing was proposed."""
    return F.array(F.struct(F.lit(0.0).alias("score"), box(F.lit(0.0), F.lit(0.0), F.lit(SIDE), F.lit(SIDE)).alias("box"), F.lit("[fallback: whole image]").alias("label")))


def finish_proposals(proposals: Column, schema: str, most: int = 20, limit: float = 0.95, contained: bool = False) -> Column:
    """Suppression, optional containment, then the best ``most``; nothing proposed -> the whole image with score 0.

    For short lists; ``operators.suppression`` does the same by row.
    """
    kept = suppress(proposals, schema, limit)
    if contained:
        kept = drop_contained(kept, schema)
    return F.when(F.size(proposals) == 0, whole_image()).otherwise(F.slice(kept, 1, most))


def prefix_length(regions: Column, global_tokens: int = 576, per_region: int = 16) -> Column:
    return F.lit(global_tokens) + regions * per_region
