"""Box and interval arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(w: Column, h: Column) -> Column:
    return w * h


def center(start: Column, size: Column) -> Column:
    return start + size / F.lit(2.0)


def center_distance(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Euclidean distance of two boxes' centers."""
    return F.sqrt(F.pow(center(ax, aw) - center(bx, bw), 2) + F.pow(center(ay, ah) - center(by, bh), 2))


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the intersection of two ranges, 0 if they are disjoint."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union; null if both boxes are empty."""
    inter = overlap_length(ax, ax + aw, bx, bx + bw) * overlap_length(ay, ay + ah, by, by + bh)
    return F.try_divide(inter.cast("double"), (aw * ah + bw * bh - inter).cast("double"))


def is_valid(start: Column, end: Column) -> Column:
    return start < end


def conjoint(s1, e1, s2, e2, inclusive: bool = True) -> Column:
    """Whether two intervals meet; touching ends count if inclusive."""
    return (s1 <= e2) & (s2 <= e1) if inclusive else (s1 < e2) & (s2 < e1)


def intersection(s1, e1, s2, e2) -> Column:
    """struct(start, end) of the common part, (0, 0) if there is none."""
    start, end = F.greatest(s1, s2), F.least(e1, e2)
    zero = F.lit(0).cast("double")
    return F.when(start < end, F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"))).otherwise(F.struct(zero.alias("start"), zero.alias("end")))


def difference(s1, e1, s2, e2) -> Column:
    """Array of up to two parts of the first interval that lie outside the second; empty parts are left out."""
    part = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"))
    apart = (s1 >= e2) | (s2 >= e1)
    pieces = F.when(apart, F.array(part(s1, e1))).otherwise(F.array(part(s1, F.least(e1, s2)), part(F.greatest(s1, e2), e1)))
    return F.filter(pieces, lambda p: p["start"] < p["end"])
