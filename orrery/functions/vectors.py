"""Vector arithmetic on array<double> columns with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    """The vector as array<double>."""
    return v.cast("array<double>")


def all_finite(v: Column) -> Column:
    """True if no element is null, NaN or infinite; false for a null vector."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def any_nonzero(v: Column) -> Column:
    """True if an element differs from zero."""
    return F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def normalized(v: Column) -> Column:
    """Row of unit length; a row of length zero stays as it is."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))[0]


def centred(v: Column) -> Column:
    """Row minus its own mean."""
    return F.transform(F.array(total(v) / F.size(v)), lambda m: F.transform(v, lambda x: x - m))[0]
