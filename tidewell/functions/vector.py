"""Vectors as arrays, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def dot(a: Column, b: Column) -> Column:
    """Sum of products in doubles; 0 for empty vectors or unequal lengths. The cosine of unit vectors."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(a: Column) -> Column:
    """Unit length; a vector of next to no length stays as it is."""
    n = norm(a)
    return F.when(n <= TINY, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def pair_features(a: Column, b: Column) -> Column:
    """a, b, their difference and its absolute values, one after another."""
    minus = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    return F.concat(double(a), double(b), minus, F.transform(minus, F.abs))
