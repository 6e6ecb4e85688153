"""Boxes as column expressions.

A corner box is a struct (x1, y1, x2, y2) of doubles; a centre box has xc, yc, w, h
in fractions of the image.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the size classes (area as a share of the image).
SMALL_AREA = 0.005
MEDIUM_AREA = 0.05
TINY_AREA = 0.00005
HUGE_AREA = 0.80

_CORNERS = ("x1", "y1", "x2", "y2")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def corners(xc, yc, w, h, width=None, height=None) -> Column:
    """Corner box of a centre box; in pixels if the image's size is given."""
    xc, yc, w, h = map(col, (xc, yc, w, h))
    sx, sy = (F.lit(1.0) if s is None else col(s) for s in (width, height))
    return F.struct(((xc - w / 2) * sx).alias("x1"), ((yc - h / 2) * sy).alias("y1"), ((xc + w / 2) * sx).alias("x2"), ((yc + h / 2) * sy).alias("y2"))


def corners_of_array(xyxy) -> Column:
    a = col(xyxy)
    return F.struct(*(a[i].cast("double").alias(n) for i, n in enumerate(_CORNERS)))


def area(box) -> Column:
    b = col(box)
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def iou(a, b) -> Column:
    """Intersection over union; 0 where the union has no area."""
    a, b = col(a), col(b)
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)
    union = area(a) + area(b) - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def iou_with_each(box, boxes) -> Column:
    """IoU of one box with every box of an array."""
    return F.transform(col(boxes), lambda b: iou(box, b))


def size_bucket(share, small: float = SMALL_AREA, medium: float = MEDIUM_AREA) -> Column:
    s = col(share)
    return F.when(s < small, "small").when(s < medium, "medium").otherwise("large")


def overflow(box) -> Column:
    """How far a corner box leaves the unit square on its worst side."""
    b = col(box)
    return F.greatest(F.lit(0.0), -b["x1"], -b["y1"], b["x2"] - 1, b["y2"] - 1)


def clipped(box) -> Column:
    """The corner box cut to the unit square."""
    b = col(box)
    return F.struct(*(F.greatest(F.lit(0.0), F.least(F.lit(1.0), b[c])).alias(c) for c in _CORNERS))


def centre(box) -> Column:
    b = col(box)
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("xc"), ((b["y1"] + b["y2"]) / 2).alias("yc"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def label_line(cls, box) -> Column:
    """A centre box as a label line, ten digits."""
    b = col(box)
    return F.format_string("%d %.10f %.10f %.10f %.10f", col(cls), b["xc"], b["yc"], b["w"], b["h"])


def aspect_difference(a, b) -> Column:
    a, b = col(a), col(b)
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))


def remapped_class(cls) -> Column:
    """The other class of two: sources that number them the other way round."""
    return 1 - col(cls)
