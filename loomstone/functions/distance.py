"""Vector distances in double precision, without UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _vector(v: Column | Sequence[float]) -> Column:
    return v.cast("array<double>") if isinstance(v, Column) else F.lit([float(x) for x in v])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column | Sequence[float], b: Column | Sequence[float], metric: str) -> Column:
    """cosine: 1 - a.b / |a||b|; dot: -a.b; euclidean; manhattan. Smaller is nearer."""
    a, b = _vector(a), _vector(b)
    if metric == "cosine":
        return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    if metric == "dot":
        return -dot(a, b)
    if metric == "euclidean":
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "manhattan":
        return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    raise ValueError(f"unknown metric {metric}")
