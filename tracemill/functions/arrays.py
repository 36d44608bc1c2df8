"""Kernels over one trace held as ARRAY<DOUBLE>; positions count from 1 and ends are included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for a row, not again for each element of an inner lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strict_mean(x: Column) -> Column:
    """Mean of an array; NULL if it is empty or an element is NULL."""
    total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(x))


def mean_of(x: Column) -> Column:
    """Mean of the elements that are there."""
    return strict_mean(F.filter(x, lambda v: v.isNotNull()))


def sample_std(x: Column) -> Column:
    """Standard deviation (n - 1) of the elements that are there; 0 for one."""
    there = F.filter(x, lambda v: v.isNotNull())
    squares = let(strict_mean(there), lambda mean: F.aggregate(there, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)))
    return F.when(F.size(there) == 1, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(squares, F.size(there) - 1)))


def dff(trace: Column, first: Column | int, last: Column | int) -> Column:
    """Change relative to the mean of frames first..last, from ``first`` on; NULL throughout where that mean is missing or 0."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    base = strict_mean(F.slice(trace, first, last - first + 1))
    return let(base, lambda f0: F.transform(F.slice(trace, first, F.size(trace) - first + 1), lambda v: F.try_divide(v - f0, f0)))


def peak(trace: Column, start: Column | int, frames: Column | int, sd: float = 2.0) -> Column:
    """struct(pk, idx, threshold, sig, sig_pk) of the window of ``frames`` frames from ``start``.

    idx counts from 1 inside the window, first on ties. The threshold is mean plus
    sd deviations of frames 1..start, and no threshold if that is 0.
    """
    start, frames = (F.lit(x) if isinstance(x, int) else x for x in (start, frames))

    def judged(x: Column) -> Column:
        window, base = F.slice(x, start, frames), F.slice(x, F.lit(1), start)
        limit = F.nullif(mean_of(base) + F.lit(float(sd)) * sample_std(base), F.lit(0.0))
        found = F.struct(F.array_max(window).alias("pk"), limit.alias("threshold"))
        sig = lambda p: F.coalesce(p["pk"] >= p["threshold"], F.lit(False))
        return let(found, lambda p: F.struct(p["pk"].alias("pk"), F.array_position(window, p["pk"]).cast("int").alias("idx"), p["threshold"].alias("threshold"), sig(p).alias("sig"), F.when(sig(p), p["pk"]).alias("sig_pk")))

    return let(trace, judged)


def frame_times(frames: Column, rate: Column, delay: Column | float = 0.0) -> Column:
    """Seconds of frames 1..n as frame / rate - delay."""
    delay = F.lit(delay) if isinstance(delay, float) else delay
    return F.transform(F.sequence(F.lit(1), frames), lambda i: i / rate - delay)


def frame_times_from_zero(frames: Column, rate: Column) -> Column:
    """Seconds of frames 1..n as (frame - 1) / rate."""
    return F.transform(F.sequence(F.lit(0), frames - 1), lambda i: i / rate)


def window_mean(trace: Column, times: Column, start: float, end: float) -> Column:
    """Mean of the frames whose time lies in start..end."""
    there = F.filter(F.arrays_zip(trace.alias("f"), times.alias("t")), lambda x: (x["t"] >= start) & (x["t"] <= end))
    return mean_of(F.transform(there, lambda x: x["f"]))


def less_mean(trace: Column, start: Column | int, frames: Column | int) -> Column:
    """The trace less its mean over ``frames`` frames from ``start``."""
    return let(trace, lambda x: let(mean_of(F.slice(x, start, frames)), lambda base: F.transform(x, lambda v: v - base)))


def first_frame(flags: Column) -> Column:
    """The first frame that holds, NULL if none does."""
    return F.nullif(F.array_position(flags, F.lit(True)), F.lit(0).cast("bigint"))


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, flag: Column) -> Column:
        now = F.when(F.coalesce(flag, F.lit(False)), acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(flags, start, step)["best"]


def segments(trace: Column, before: int, length: int, count: int) -> Column:
    """Consecutive segments of ``length`` frames after the first ``before``."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.slice(trace, F.lit(before + 1) + k * length, F.lit(length)))


def onset_aligned(trace: Column, onset: Column, least_onset: Column, most_onset: Column) -> Column:
    """As many frames before the onset as the least has, and after as the greatest leaves."""
    return F.slice(trace, onset - least_onset + 1, F.size(trace) - most_onset + least_onset)


def scaled(a: Column, b: Column, share: float = 0.8) -> Column:
    """a - share * (a - b), element by element: a trace with a share of its surround taken out."""
    return F.zip_with(a, b, lambda x, y: x - F.lit(share) * (x - y))


def zero_to_one(x: Column, shifted: bool = True) -> Column:
    """(x - min) / (max - min); not ``shifted``: divided by the plain max."""
    ends = F.struct(F.array_min(x).alias("low"), F.array_max(x).alias("high"))
    return let(ends, lambda e: F.transform(x, lambda v: F.try_divide(v - e["low"], e["high"] - e["low"] if shifted else e["high"])))


def linear_index(i: Column, j: Column, rows: Column | int) -> Column:
    """Column-major index of (i, j), NULL where either is."""
    return i + (j - 1) * rows


def octaves(a: Column, b: Column) -> Column:
    """log2(b / a)."""
    return F.log2(F.try_divide(b, a))
