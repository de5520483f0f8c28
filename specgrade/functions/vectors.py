"""Vector expressions on ``array<float|double>`` columns, in double precision."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F

NORM_FLOOR = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; the norm is floored, so a zero vector stays zero."""
    norm = F.greatest(l2_norm(v), F.lit(NORM_FLOOR))
    # Beside the vector, not inside the lambda, which would take the norm again for every component.
    return F.zip_with(as_double(v), F.array_repeat(norm, F.size(v)), lambda x, n: x / n)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def mean_vector(v: Column) -> Column:
    """Aggregate: element-wise mean, combined on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))
