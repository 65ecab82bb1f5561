"""Boxes as structs of x_min, y_min, x_max, y_max in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x_min"), y0.alias("y_min"), x1.alias("x_max"), y1.alias("y_max"))


def area(b: Column) -> Column:
    """G1."""
    return (b["x_max"] - b["x_min"]) * (b["y_max"] - b["y_min"])


def to_pixels(b: Column, width: int, height: int) -> Column:
    """Truncated towards zero."""
    return F.struct(*[(b[k] * size).cast("int").alias(k) for k, size in (("x_min", width), ("y_min", height), ("x_max", width), ("y_max", height))])


def pad(b: Column, ratio: float) -> Column:
    """Each side moves out by ratio times the box's size, kept in [0, 1]."""
    w, h = (b["x_max"] - b["x_min"]) * ratio, (b["y_max"] - b["y_min"]) * ratio
    low = lambda x: F.greatest(F.lit(0.0), x)
    high = lambda x: F.least(F.lit(1.0), x)
    return box(low(b["x_min"] - w), low(b["y_min"] - h), high(b["x_max"] + w), high(b["y_max"] + h))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that are apart or touch."""
    w = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"])
    h = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])
    both = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def valid(b: Column) -> Column:
    """Within [0, 1], and not empty."""
    inside = (b["x_min"] >= 0) & (b["y_min"] >= 0) & (b["x_max"] <= 1) & (b["y_max"] <= 1)
    return F.coalesce(inside & (b["x_max"] > b["x_min"]) & (b["y_max"] > b["y_min"]), F.lit(False))
