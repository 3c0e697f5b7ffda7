"""Vector distances over ``array<float>``, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null if either vector is null or the lengths differ."""
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine_distance(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)
