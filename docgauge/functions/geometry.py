"""Boxes as column expressions. A box is an array<double> [x1, y1, x2, y2]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge.functions.text import _c


def _zeros() -> Column:
    return F.array(*[F.lit(0.0)] * 4)


def box(x1, y1, x2, y2) -> Column:
    return F.array(*[_c(x).cast("double") for x in (x1, y1, x2, y2)])


def truncated(x: Column) -> Column:
    """Toward zero."""
    return x.cast("long").cast("double")


def to_xyxy(b, fmt: str = "auto") -> Column:
    """xywh boxes become corners. `auto` takes a box for xywh where a second corner lies before the first; any length but 4 gives zeros."""
    b = _c(b)
    added = F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])
    same = F.array(b[0], b[1], b[2], b[3])
    out = {"xywh": added, "xyxy": same, "auto": F.when((b[2] < b[0]) | (b[3] < b[1]), added).otherwise(same)}[fmt]
    return F.when(F.size(b) != 4, _zeros()).otherwise(out)


def corners(boxes, fmt: str = "auto") -> Column:
    """An array of boxes, each as corners."""
    return F.transform(_c(boxes), lambda b: to_xyxy(b, fmt))


def iou(a, b, clamp: bool = False) -> Column:
    """Intersection over union; 0 for boxes of other lengths or an empty union. `clamp` counts the area of an inverted box as 0."""
    a, b = _c(a), _c(b)
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0.0), (x[2] - x[0]) * (x[3] - x[1])) if clamp else (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - wide * high
    return F.when((F.size(a) == 4) & (F.size(b) == 4) & (union > 0), F.try_divide(wide * high, union)).otherwise(0.0)


def _corners(xs: Column, ys: Column) -> Column:
    return F.array(*[truncated(x) for x in (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))])


def flat_quad(q) -> Column:
    """[x, y, x, y, ...] -> its box, truncated."""
    q = _c(q)
    return _corners(F.filter(q, lambda _, i: i % 2 == 0), F.filter(q, lambda _, i: i % 2 == 1))


def nested_quad(q) -> Column:
    """[[x, y], ...] -> its box, truncated."""
    q = _c(q)
    return _corners(F.transform(q, lambda p: p[0]), F.transform(q, lambda p: p[1]))


def vertices(v, width, height) -> Column:
    """Vertices as structs of x and y in 0..1 -> pixels, truncated; none gives zeros."""
    v = _c(v)
    xs, ys = F.transform(v, lambda p: F.coalesce(p["x"], F.lit(0.0)) * _c(width)), F.transform(v, lambda p: F.coalesce(p["y"], F.lit(0.0)) * _c(height))
    return F.when(F.size(v) > 0, _corners(xs, ys)).otherwise(_zeros())


def scaled_ltrb(left, upper, right, lower, width, height) -> Column:
    """Sides in 0..1 -> pixels, truncated."""
    return F.array(*[truncated(_c(v) * _c(d)) for v, d in ((left, width), (upper, height), (right, width), (lower, height))])


def bins(x1, y1, x2, y2, width, height, top: int = 999) -> Column:
    """Bins 0..999 -> pixels: divided, multiplied, truncated, in that order."""
    return F.array(*[truncated(_c(v).cast("double") / F.lit(float(top)) * _c(d)) for v, d in ((x1, width), (y1, height), (x2, width), (y2, height))])


def parse_box(text) -> Column:
    """A box written as "[x1, y1, x2, y2]", truncated; anything else gives zeros."""
    parts = F.transform(F.split(F.regexp_replace(_c(text), r"^[\[\]]+|[\[\]]+$", ""), ","), lambda x: truncated(F.trim(x).try_cast("double")))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull()), parts).otherwise(_zeros())


def padded_crop(b, width, height, pad: int = 20) -> Column:
    b = _c(b)
    return F.array(F.greatest(F.lit(0.0), b[0] - pad), F.greatest(F.lit(0.0), b[1] - pad), F.least(_c(width).cast("double"), b[2] + pad), F.least(_c(height).cast("double"), b[3] + pad))


def crop_offset(b, crop, pad: int = 20) -> Column:
    """A box in the coordinates of a padded crop; unchanged without one."""
    b, crop = _c(b), _c(crop)
    dx, dy = F.greatest(F.lit(0.0), crop[0] - pad), F.greatest(F.lit(0.0), crop[1] - pad)
    return F.when(crop.isNull(), b).otherwise(F.array(b[0] - dx, b[1] - dy, b[2] - dx, b[3] - dy))


def union_box(boxes) -> Column:
    """The box around an array of boxes; none gives zeros."""
    bs = _c(boxes)
    side = lambda k, f: f(F.transform(bs, lambda b: b[k]))
    return F.when(F.size(bs) > 0, F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))).otherwise(_zeros())
