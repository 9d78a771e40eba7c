"""Vector distances on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when the product of the norms is about 0."""
    return cosine_of(a, b, F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_of(a: Column, b: Column, norms: Column) -> Column:
    """X8 where the product of the norms is known."""
    return F.when(norms > 1e-9, dot(a, b) / norms).otherwise(0.0)


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "l2":
        return squared_distance(a, b)
    raise ValueError(f"unknown metric {metric!r}")
