"""Vector expressions over arrays of numbers, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Of length one; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def scaled(v: Column, sigma: Column, power: float, dims: int | None = None) -> Column:
    """The first dims values times sigma to the power; power 0 leaves them as they are."""
    v = F.slice(v, 1, dims) if dims else v
    if power == 0:
        return F.transform(v, lambda x: x.cast("double"))
    return F.transform(v, lambda x, i: x.cast("double") * F.pow(F.get(sigma, i), F.lit(float(power))))
