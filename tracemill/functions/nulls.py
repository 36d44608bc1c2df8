"""Missing values: NaN becomes NULL on the way in, and every helper skips or passes NULL by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NULL for NaN."""
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or either is missing."""
    return F.try_divide(a, b)


def sem(x: Column) -> Column:
    """Aggregate: standard error of the mean; 0 for one value, NULL for none."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x) / F.sqrt(F.count(x)))


def first_of_largest(value: Column, position: Column) -> Column:
    """Aggregate: the position of the largest value, the first on ties; NULL values are not looked at."""
    return -F.max(F.when(value.isNotNull(), F.struct(value.alias("v"), (-position).alias("p"))))["p"]


def null_if_zero(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def null_if_empty(x: Column) -> Column:
    """NULL for an empty array."""
    return F.when(F.size(x) > 0, x)
