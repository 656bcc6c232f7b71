"""Vectors as array<double> columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(v: Column) -> Column:
    """Nulls and NaN become 0."""
    return F.transform(v.cast("array<double>"), lambda x: F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, held to [0, 1]; a zero vector is at distance 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.coalesce(cosine(a, b), F.lit(0.0))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def triplet_margin_loss(anchor: Column, positive: Column, negative: Column, margin: float = 0.5) -> Column:
    return F.greatest(distance(anchor, positive) - distance(anchor, negative) + F.lit(margin), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector of length 1 in the same direction; a zero vector stays."""
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x, norm(a)), F.lit(0.0)))


def unit_sums(rows: DataFrame, group: str, features: str = "features") -> DataFrame:
    """(c, n, s): per group the number of its rows and the sum of their unit vectors, added up as whole vectors."""
    units = rows.select(F.col(group).alias("c"), array_to_vector(unit(F.col(features).cast("array<double>"))).alias("u"))
    out = units.groupBy("c").agg(F.count("*").alias("n"), Summarizer.sum(F.col("u")).alias("s"))
    return out.select("c", "n", vector_to_array("s").alias("s"))
