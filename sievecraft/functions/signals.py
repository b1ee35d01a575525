"""Statistics of arrays inside their row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(values) > 0, _sum(values) / F.size(values))


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    return let(mean(values), lambda m: F.sqrt(mean(F.transform(values, lambda x: (x - m) * (x - m)))))


def mean_step(values: Column) -> Column:
    """Mean absolute difference of neighbours; null for fewer than two values."""
    return mean(F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), lambda a, b: F.abs(b - a)))


def guarded_correlation(a: Column, b: Column, tolerance: float = 1e-8) -> Column:
    """Pearson's correlation of two arrays; where one does not vary, 1 if they agree and 0 otherwise."""

    def both(ma: Column) -> Column:
        def full(mb: Column) -> Column:
            top = _sum(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
            bottom = F.sqrt(_sum(F.transform(a, lambda x: (x - ma) * (x - ma))) * _sum(F.transform(b, lambda y: (y - mb) * (y - mb))))
            same = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance + 1e-5 * F.abs(y)), lambda x: x)
            return let(bottom, lambda d: F.when(d == 0, F.when(same, 1.0).otherwise(0.0)).otherwise(top / d))

        return let(mean(b), full)

    return let(mean(a), both)
