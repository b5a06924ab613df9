"""Vector arithmetic on `array<float|double>` columns, evaluated in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusengine.functions.arrays import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2sq(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gap, F.lit(0.0), lambda acc, g: acc + g * g)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column, guard: float = 1e-9) -> Column:
    """Vector divided by its length; the guard keeps zero vectors finite."""
    return let(norm(a) + guard, lambda n: F.transform(a, lambda x: x.cast("double") / n))
