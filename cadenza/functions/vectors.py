"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; null for a zero, null or non-finite vector."""
    n = norm(a)
    return F.when((n > 0) & is_finite(n), F.transform(a, lambda x: x.cast("double") / n))


def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def clipped(a: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def channel_mean(channels: Column) -> Column:
    """Mean over an array of equally long channels."""
    n = F.size(channels)
    total = F.aggregate(F.slice(channels, 2, F.greatest(n - 1, F.lit(0))), F.element_at(channels, 1), lambda s, c: F.zip_with(s, c, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def first_seconds(samples: Column, seconds: float, rate: int = 16_000) -> Column:
    return F.slice(samples, 1, round(seconds * rate))
