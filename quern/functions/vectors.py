"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L2, COSINE, DOT = "l2", "cosine", "dot"


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 where the lengths differ."""
    a, b = doubles(a), doubles(b)
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x * y))).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite where the lengths differ."""
    a, b = doubles(a), doubles(b)
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))).otherwise(float("inf"))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where the lengths differ or a vector is empty or zero."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), dot(a, b) / F.when(lengths > 0, lengths)).otherwise(0.0)


def metric(name: str, a: Column, b: Column) -> Column:
    return {L2: l2, COSINE: cosine, DOT: dot}[name](a, b)


def best_first(name: str, score: Column) -> Column:
    """The order of results: small distances, large similarities first; scores that agree to nine digits tie."""
    return F.round(score, 9).asc() if name == L2 else F.round(score, 9).desc()


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))
