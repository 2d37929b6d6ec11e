"""Vector arithmetic on ``array<float|double>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays zero (the norm is floored at 1e-12)."""
    size = F.greatest(norm(v), F.lit(NORM_FLOOR))
    # The outer one-element transform binds the norm, so it is computed once per row.
    scaled = F.transform(F.array(size), lambda s: F.transform(v, lambda x: x.cast("double") / s))
    return scaled[0]


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(
        a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
