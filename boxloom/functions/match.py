"""Costs of a tracking network's edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxloom.functions.geometry import center_distance, iou
from boxloom.functions.vectors import cosine

# Exponents of the match probability, and what keeps logarithms and quotients finite.
EXPONENTS = {"similarity": 3.5, "iou": 1.5, "distance": 2.0, "time": 1.0, "scale": 1.5, "scaled_distance": 4.5}
EPS = 1e-5
DECAY = 0.995


def time_decay(frames: Column, fps: float) -> Column:
    return F.pow(F.lit(DECAY), F.lit(fps) * frames - F.lit(1.0))


def match_cost(a: str, b: str, frame_width: float, fps: float) -> Column:
    """log2(1 - p + EPS), p the weighted geometric mean of six likenesses. a, b: prefixes of box columns.

    A negative cosine counts as 0, so that its fractional power is defined.
    """
    c = lambda p, n: F.col(f"{p}{n}")
    box = lambda p: [c(p, n) for n in ("x", "y", "w", "h")]
    area_a, area_b = (c(p, "w") * c(p, "h") for p in (a, b))
    small, large = F.sqrt(F.least(area_a, area_b).cast("double")), F.sqrt(F.greatest(area_a, area_b).cast("double"))
    gap = center_distance(*box(a), *box(b))
    parts = {
        "similarity": F.greatest(F.coalesce(cosine(c(a, "features"), c(b, "features")), F.lit(0.0)), F.lit(0.0)),
        "iou": (F.lit(1.0) + F.coalesce(iou(*box(a), *box(b)), F.lit(0.0))) / 2,
        "distance": F.lit(1.0) - gap / F.lit(float(frame_width)),
        "time": time_decay(c(b, "frame") - c(a, "frame"), fps),
        "scale": F.coalesce(F.try_divide(small, large), F.lit(0.0)),
        "scaled_distance": F.lit(1.0) / (F.lit(1.0) + gap / (F.lit(EPS) + small)),
    }
    product = F.lit(1.0)
    for name, x in parts.items():
        product = product * F.pow(x, F.lit(EXPONENTS[name]))
    return F.log2(F.lit(1.0) - F.pow(product, F.lit(1.0 / sum(EXPONENTS.values()))) + F.lit(EPS))


def detection_cost(confidence: Column) -> Column:
    c = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), confidence))
    return F.log2((F.lit(1.0) - c) / c)


def flow_end_cost(probability: Column) -> Column:
    return -F.log2(probability)
