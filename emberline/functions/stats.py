"""The scalar formulas behind features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log6(x: Column) -> Column:
    return F.round(F.log1p(F.greatest(x.cast("double"), F.lit(0.0))), 6)


def growth(now: Column, before: Column) -> Column:
    return F.round(F.log1p(now.cast("double")) - F.log1p(before.cast("double")), 6)


def burstiness(values: Column) -> Column:
    """(sd - mean) / (sd + mean) over an array; NULL where both are zero."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.when(F.sqrt(var) + mean > 0, F.round((F.sqrt(var) - mean) / (F.sqrt(var) + mean), 6))


def hhi(counts: Column) -> Column:
    """Sum of squared shares of an array of counts; NULL for none."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.round(F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x / total) * (x / total)), 6))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
