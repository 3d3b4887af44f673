"""Vector and weight arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BONUS = 0.3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is null, a zero vector, or of another length."""
    value = dot(a, b) / (norm(a) * norm(b))
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), value).otherwise(F.lit(0.0))


def bonus(weight: Column) -> Column:
    """A learned weight's bounded addition to similarity."""
    return F.when(weight > 0, F.lit(MAX_BONUS) * F.tanh(weight)).otherwise(F.lit(0.0))


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Both ends of an undirected edge in the order of strings."""
    return F.least(a, b), F.greatest(a, b)
