"""Kernels and distances of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a.cast("double") * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def unit(x: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(x)
    return F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0)))


def cosine(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(dot(x, y), norm(x) * norm(y)), F.lit(0.0))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(x, y, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))))


def manhattan(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: F.abs(a.cast("double") - b)))


def sigmoid(x: Column, y: Column, gamma: float | Column, c0: float = 1.0) -> Column:
    return F.tanh(dot(x, y) * gamma + c0)


def polynomial(x: Column, y: Column, gamma: float | Column, degree: int = 3, c0: float = 1.0) -> Column:
    return F.pow(dot(x, y) * gamma + c0, F.lit(degree))


def rbf(x: Column, y: Column, gamma: float | Column) -> Column:
    return F.exp(F.lit(-1.0) * gamma * F.pow(euclidean(x, y), F.lit(2)))


def pairwise(metric: str, x: Column, y: Column, dim: int | None = None) -> Column:
    """A kernel or distance by name; gamma is 1 / dim, the vectors' own size if not given."""
    gamma = 1.0 / dim if dim else F.lit(1.0) / F.size(x)
    table = {
        "linear": dot, "cosine": cosine, "cosine_distance": lambda a, b: 1 - cosine(a, b), "euclidean": euclidean, "l2": euclidean,
        "manhattan": manhattan, "l1": manhattan, "cityblock": manhattan, "sigmoid": lambda a, b: sigmoid(a, b, gamma),
        "polynomial": lambda a, b: polynomial(a, b, gamma), "rbf": lambda a, b: rbf(a, b, gamma),
    }
    if metric not in table:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(sorted(table))}")
    return table[metric](x, y)
