"""From recordings and pulses to one row per (cell, stimulus, repetition), and the pipelines on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import arrays
from tracemill.operators.traces import exploded, merged_onsets, peaks


def pulses_of(recordings: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """One row per pulse, numbered from 1: parallel lists of a recording taken apart together."""
    zipped = F.posexplode(F.arrays_zip(*lists)).alias("at", "x")
    return recordings.select(*keys, zipped).select(*keys, (F.col("at") + 1).alias("pulse"), *[F.col(f"x.{c}").alias(c) for c in lists])


def equalised(traces: DataFrame, group: list[str], trace: str) -> DataFrame:
    """Traces of a group cut to its shortest; the lengths alone are aggregated."""
    least = traces.groupBy(*group).agg(F.min(F.size(trace)).alias("_n"))
    return traces.join(least, group).withColumn(trace, F.slice(trace, F.lit(1), F.col("_n"))).drop("_n")


def pulse_traces(traces: DataFrame, pulses: DataFrame, recording: list[str], trace: str, before: int, length: int) -> DataFrame:
    """Each pulse of a recording with the part of every trace that belongs to it; parts beyond a trace's end are left out."""
    start = F.lit(before + 1) + (F.col("pulse") - 1) * length
    cut = traces.join(pulses, recording).where(start + length - 1 <= F.size(trace))
    return cut.withColumn(trace, F.slice(trace, start, F.lit(length)))


def repetitions(rows: DataFrame, cell: list[str], stimulus: list[str], order: list[str]) -> DataFrame:
    """Rows numbered within cell and stimulus: one row per repetition, whose traces are never gathered in one."""
    return rows.withColumn("rep", F.row_number().over(Window.partitionBy(*cell, *stimulus).orderBy(*order)))


def noise_burst_peaks(trials: DataFrame, sound: list[str], onset: str, trace: str, rate: float, pulse_ms: float, sd: float = 2.0) -> DataFrame:
    """(sound, n, pk, idx, threshold, sig): dF/F over the second before onset, onsets merged, repetitions averaged, peak.

    ``onset`` is in frames; the baseline is the ``rate`` frames up to it, so in every
    shifted trace the onset is frame ``rate``.
    """
    frames = int(rate)
    whole = trials.where(F.col(onset) >= frames)
    change = whole.withColumn("_first", F.col(onset) - frames + 1)
    change = change.withColumn(trace, arrays.dff(F.col(trace), F.col("_first"), F.col(onset)))
    # dF/F already starts with the baseline, so every onset is at the same frame
    change = change.withColumn(onset, F.lit(frames)).drop("_first")
    merged = merged_onsets(change, sound, onset, trace, F.lit(frames))
    long = exploded(merged, sound, trace)
    mean = long.groupBy(*sound, "frame").agg(F.avg("f").alias("f"), F.count("f").alias("reps"))
    window = int(-(-pulse_ms * rate // 1000)) + 2
    return peaks(mean, sound, "f", frames, window, sd, {"n": F.max("reps")})


def contrast_peaks(trials: DataFrame, cell: list[str], contrast: str, trace: str, base: tuple[int, int], second: tuple[int, int], crop: int, start: int, frames: int, sd: float = 2.0) -> DataFrame:
    """(cell, contrast, pk, sig) of dF/F less its mean in a second baseline, averaged over repetitions.

    Subtracting a mean commutes with averaging, so the second baseline is taken off
    each trial's array before the frames are averaged.
    """
    x = arrays.dff(F.col(trace), base[0], base[1])
    offset = base[0] - 1
    rows = trials.withColumn("_d", x)
    rows = rows.withColumn("_d", arrays.less_mean(F.col("_d"), second[0] - offset, second[1] - second[0] + 1))
    rows = rows.withColumn("_d", F.slice("_d", F.lit(crop - offset), F.size("_d")))
    mean = exploded(rows, [*cell, contrast], "_d").groupBy(*cell, contrast, "frame").agg(F.avg("f").alias("f"))
    return peaks(mean, [*cell, contrast], "f", start - crop + 1, frames, sd)


def responsive_in_all(found: DataFrame, cell: list[str], contrast: str, contrasts: list) -> DataFrame:
    """(cell, one column for each contrast, all_sig): significant in each of the contrasts; one row each is required."""
    sig: Column = F.bool_and(F.when(F.col(contrast).isin(*contrasts), F.col("sig"))) & (F.count_if(F.col(contrast).isin(*contrasts)) == len(contrasts))
    return found.groupBy(*cell).agg(*[F.max(F.when(F.col(contrast) == c, F.col("pk"))).alias(str(c)) for c in contrasts], sig.alias("all_sig"))
