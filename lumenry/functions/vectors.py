"""Functions over arrays of floats; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column, least: float = 1e-9) -> Column:
    """A vector of length one; of a zero vector, zeros."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(least))
    return F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))
