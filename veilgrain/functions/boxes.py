"""Box arithmetic on flat ``x, y, w, h`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x", "y", "w", "h"))


def intersection(a, b) -> Column:
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    dx = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    dy = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(F.lit(0), dx) * F.greatest(F.lit(0), dy)


def iou(a, b) -> Column:
    """Intersection over union, 0 when the union is empty."""
    inter = intersection(a, b)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return F.when(union > 0, inter.cast("double") / union.cast("double")).otherwise(F.lit(0.0))


def js_round(value: Column) -> Column:
    """Round half up (towards positive infinity), as JavaScript does."""
    return F.floor(value + F.lit(0.5))


def contains_point(b, px: Column, py: Column) -> Column:
    x, y, w, h = b
    return px.between(x, x + w) & py.between(y, y + h)
