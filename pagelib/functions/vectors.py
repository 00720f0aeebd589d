"""Vector expressions: dot products and unit vectors over array columns, means as aggregates."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""
    v = doubles(v)
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def add(a, b, weight: float = 1.0) -> Column:
    """a + weight * b; a missing side drops its term."""
    a, b = doubles(a), doubles(b)
    both = F.zip_with(a, b, lambda x, y: x + F.lit(weight) * y)
    return F.coalesce(both, a, F.transform(b, lambda y: F.lit(weight) * y))


def mean(v) -> Column:
    """Aggregate: element-wise mean, combined map-side; NULL of no rows."""
    v = _c(v)
    some = F.count(v)
    return F.when(some > 0, vector_to_array(Summarizer.mean(array_to_vector(doubles(v)))))
