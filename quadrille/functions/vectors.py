"""Vector similarity on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [-1, 1]; zero vectors give 0."""
    size = norm(a) * norm(b)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(size > 0, dot(a, b) / size).otherwise(0.0)))
