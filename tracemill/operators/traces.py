"""Traces in long form: one row per (keys, frame). Each operator groups by the keys given to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.nulls import first_of_largest, null_if_zero, sem


def numbered_frames(samples: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, frame, f): the samples of a trace numbered from 1."""
    trace = Window.partitionBy(*keys).orderBy(*order)
    return samples.select(*keys, F.row_number().over(trace).alias("frame"), F.col(value).cast("double").alias("f"))


def relative_change(traces: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """(keys, frame, dff) from frame ``first`` on; NULL if a baseline frame is NULL or their mean is 0."""
    inside = F.col("frame").between(first, last)
    base = Window.partitionBy(*keys)
    f0 = F.avg(F.when(inside, F.col("f"))).over(base)
    whole = F.count(F.when(inside & F.col("f").isNotNull(), 1)).over(base) == last - first + 1
    return traces.withColumn("f0", F.when(whole, f0)).where(F.col("frame") >= first).select(*keys, "frame", F.try_divide(F.col("f") - F.col("f0"), F.col("f0")).alias("dff"))


def peaks(traces: DataFrame, keys: list[str], value: str, start: int, frames: int, sd: float = 2.0, more: dict[str, Column] | None = None) -> DataFrame:
    """(keys, pk, idx, threshold, sig) and the aggregates of ``more``: one aggregation, so partial sums combine before the shuffle."""
    x = F.col(value)
    window = F.when(F.col("frame").between(start, start + frames - 1), x)
    base = F.when(F.col("frame") <= start, x)
    spread = F.when(F.count(base) == 1, F.lit(0.0)).otherwise(F.stddev_samp(base))
    position = F.col("frame") - F.lit(start - 1)
    found = traces.groupBy(*keys).agg(F.max(window).alias("pk"), first_of_largest(window, position).alias("idx"), (F.avg(base) + F.lit(float(sd)) * spread).alias("threshold"), *[v.alias(k) for k, v in (more or {}).items()])
    threshold = null_if_zero(F.col("threshold"))
    return found.select(*keys, "pk", "idx", threshold.alias("threshold"), F.coalesce(F.col("pk") >= threshold, F.lit(False)).alias("sig"), *(more or {}))


def mean_and_sem(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, n, mean, sem) of the values that are there."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sem(value).alias("sem"))


def two_level(rows: DataFrame, cell: list[str], keys: list[str], value: Column) -> DataFrame:
    """Mean of each cell first, then mean and SEM over cells, so that no cell counts more than once."""
    inner = rows.groupBy(*cell, *keys).agg(F.avg(value).alias("cell_mean"))
    return mean_and_sem(inner, keys, F.col("cell_mean"))


def epoch_means(rows: DataFrame, keys: list[str], value: Column, time: Column, epochs: dict[str, tuple[float, float]]) -> DataFrame:
    """The mean of each epoch (name -> start, end in seconds, both included) in one pass."""
    return rows.groupBy(*keys).agg(*[F.avg(F.when(time.between(a, b), value)).alias(name) for name, (a, b) in epochs.items()])


def exploded(arrays: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, frame, f) from a column of arrays; frames count from 1."""
    return arrays.select(*keys, F.posexplode(value).alias("at", "f")).select(*keys, (F.col("at") + 1).alias("frame"), F.col("f").cast("double").alias("f"))


def merged_onsets(arrays: DataFrame, sound: list[str], onset: str, trace: str, baseline: Column) -> DataFrame:
    """Trials of one sound with different onsets as repetitions of the earliest: (sound, onset, rep, f).

    Every trace starts ``baseline`` frames before its onset and is cut to the
    shortest length, which is an aggregate of one number.
    """
    shifted = arrays.select("*", F.slice(F.col(trace), F.col(onset) - baseline + 1, F.size(trace) - F.col(onset) + baseline).alias("_cut"))
    shortest = shifted.agg(F.min(F.size("_cut")).alias("_least"))  # one number
    earliest = arrays.groupBy(*sound).agg(F.min(onset).alias("_onset"))  # partial minima before the exchange; a row for each sound
    found = shifted.join(F.broadcast(shortest)).join(earliest, sound)
    return found.select(*sound, F.col("_onset").alias(onset), *[c for c in arrays.columns if c not in (*sound, onset, trace)], F.slice("_cut", F.lit(1), F.col("_least")).alias(trace))
