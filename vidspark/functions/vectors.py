"""Column arithmetic on vectors (array<float>) and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b); 1.0 where either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / scale)


def cosine_distance_eps(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Variant with eps added to each norm, clipped to [0, 2]."""
    d = 1.0 - dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), d))


def valid_vector(v: Column, dim: int) -> Column:
    return F.coalesce(F.size(v) == dim, F.lit(False))


def confidence(distance: Column) -> Column:
    return 1.0 - distance


def confidence_pct(distance: Column) -> Column:
    return F.round((1.0 - distance) * 100, 2)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two struct<x1,y1,x2,y2>; 0 where they only touch or have no area."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area_a = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])
    area_b = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    inter = w * h
    union = area_a + area_b - inter
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        x2.cast("double").alias("x2"), y2.cast("double").alias("y2"),
    )


def scale_int(value: Column, original: Column, resized: Column) -> Column:
    """Coordinate back on the original image, truncated to an integer."""
    return (value * (original / resized)).cast("long")


def scale_percent(value: Column, resized: Column) -> Column:
    return F.round(value / resized * 100, 2)


def box_with_margin(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, margin: float = 0.2) -> Column:
    """Box grown by `margin` of its size on each side, integer-truncated and clamped to the image."""
    dx, dy = (w * margin).cast("long"), (h * margin).cast("long")
    return F.struct(
        F.greatest(F.lit(0), x - dx).alias("x1"), F.greatest(F.lit(0), y - dy).alias("y1"),
        F.least(width, x + w + dx).alias("x2"), F.least(height, y + h + dy).alias("y2"),
    )


_XYWH = "struct<x:double,y:double,w:double,h:double>"
_LAYOUTS = (
    "struct<facial_area:string,bbox:array<double>,x1:double,y1:double,x2:double,y2:double,region:string>"
)


def normalise_box(payload: Column) -> Column:
    """One struct<x1,y1,x2,y2> out of the five historic JSON layouts, first layout present wins;
    the whole-image dummy (0,0,100,100) where none is present."""
    p = F.from_json(payload, _LAYOUTS)

    def from_area(text: Column) -> Column:
        o = F.from_json(text, _XYWH)
        x, y = F.coalesce(o["x"], F.lit(0.0)), F.coalesce(o["y"], F.lit(0.0))
        return box(x, y, x + F.coalesce(o["w"], F.lit(0.0)), y + F.coalesce(o["h"], F.lit(0.0)))

    listed = F.from_json(p["facial_area"], "array<double>")
    bb = p["bbox"]
    return F.coalesce(
        F.when(p["facial_area"].startswith("{"), from_area(p["facial_area"])),
        F.when(F.size(listed) == 4, box(listed[0], listed[1], listed[0] + listed[2], listed[1] + listed[3])),
        F.when(F.size(bb) == 4, box(bb[0], bb[1], bb[2], bb[3])),
        F.when(
            p["x1"].isNotNull() & p["y1"].isNotNull() & p["x2"].isNotNull() & p["y2"].isNotNull(),
            box(p["x1"], p["y1"], p["x2"], p["y2"]),
        ),
        F.when(p["region"].startswith("{"), from_area(p["region"])),
        box(F.lit(0), F.lit(0), F.lit(100), F.lit(100)),
    )
