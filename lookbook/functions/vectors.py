"""Expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(float(by)))


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


def weighted_concat(*blocks: tuple[Column, float]) -> Column:
    return F.concat(*(scale(b, w) if w != 1 else b for b, w in blocks))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    if metric == "euclidean":
        return F.sqrt(squared_distance(a, b))
    if metric == "cosine":
        return 1 - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    raise ValueError(f"unknown metric {metric!r}")
