"""Student's t and the normal distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of a published rational approximation of the complementary error function, of which the relative error is below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Degrees of freedom up to which the series has all its terms; beyond them t is turned into a normal deviate, with an error of the order of 1 / df squared.
SERIES = 10_000
HALVINGS = 50


def normal_tail(z: Column) -> Column:
    """The share of a normal distribution beyond |z| on one side."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = F.lit(c) + t * power
    return t * F.exp(power - x * x) / 2


def normal_cdf(z: Column) -> Column:
    """The normal distribution function."""
    return F.when(z > 0, 1 - normal_tail(z)).otherwise(normal_tail(z))


def normal_two_sided(z: Column) -> Column:
    return 2 * normal_tail(z)


def inside_angle(angle: Column, df: Column) -> Column:
    """P(|T| < t) for whole ``df`` where t = sqrt(df) tan(angle): the finite sum over powers of the angle's cosine, of one form for even df and of another for odd."""
    even, cosine = df % 2 == 0, F.cos(angle)
    square = cosine * cosine
    first = F.when(even, 1.0).when(df > 1, cosine).otherwise(0.0)
    more = F.when(df >= 4, F.sequence(F.lit(1), F.floor((df - 2) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    ratio = lambda k: F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1))
    step = lambda s, k: F.struct((s["term"] * ratio(k) * square).alias("term"), (s["sum"] + s["term"] * ratio(k) * square).alias("sum"))
    total = F.aggregate(more, F.struct(first.alias("term"), first.alias("sum")), step)["sum"]
    return F.when(even, F.sin(angle) * total).otherwise(2 / math.pi * (angle + F.sin(angle) * total))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= t) of Student's t; NULL without degrees of freedom."""
    whole, size = df.cast("int"), F.abs(t)
    normal = size * (1 - 1 / (4.0 * df)) / F.sqrt(1 + size * size / (2.0 * df))
    series = F.greatest(1 - inside_angle(F.atan(size / F.sqrt(df.cast("double"))), F.least(whole, F.lit(SERIES))), F.lit(0.0))
    return F.when((df > 0) & t.isNotNull(), F.when(df <= SERIES, series).otherwise(normal_two_sided(normal)))


def t_quantile(level: float, df: Column, z: float) -> Column:
    """The t that |T| stays below with probability ``level``, by halving the range of the angle; beyond SERIES from the normal quantile ``z``."""
    whole = F.least(df.cast("int"), F.lit(SERIES))

    def halved(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        below = inside_angle(middle, whole) < level
        return F.struct(F.when(below, middle).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("low"), F.lit(math.pi / 2).alias("high")), halved)
    series = F.sqrt(df.cast("double")) * F.tan((ends["low"] + ends["high"]) / 2)
    return F.when(df > 0, F.when(df <= SERIES, series).otherwise(z + (z**3 + z) / 4 / df))
