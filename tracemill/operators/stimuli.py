"""Stimulus tables: parameters and pulses of recordings, read by the family that they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import stimnames
from tracemill.functions.nulls import null_if_empty

#: What each family's names tell; a table holds the columns of all, NULL where a family lacks them.
EXTRACTORS = {
    "CGC": lambda n: stimnames.pure_tone(n) | {k: v for k, v in stimnames.noise_contrast(n).items()},
    "dContrast": lambda n: stimnames.contrast_change(n) | {k: v for k, v in stimnames.noise_contrast(n).items() if k in ("band_khz", "chord_ms", "total_s")},
    "BPN": stimnames.noise_burst,
    "Spont": stimnames.silence,
}


def by_family(family: Column, pulse: Column) -> dict[str, Column]:
    """Each parameter from the extractor of the row's own family."""
    out: dict[str, Column] = {}
    for name, extract in EXTRACTORS.items():
        for column, value in extract(pulse).items():
            out[column] = F.when(family == name, value) if column not in out else out[column].when(family == name, value)
    return out


def stimulus_table(recordings: DataFrame) -> DataFrame:
    """One row per recording and pulse: (animal, tif, treatment, family, processed, trig_delay, isi, total_pulses, pulse, raw_pulse, base, parameters).

    ``recordings`` (animal, tif, treatment, pulse_set, trig_delay, isi, pulses: names
    in order). Recordings of no family are left out, those without pulses keep one
    row with NULL. Families of which an animal has one recording are not processed;
    pupil recordings are listed alone. Recordings are read once and counted by a
    window before their pulses become rows. A NULL animal's recordings are kept out.
    """
    rows = recordings.withColumn("family", stimnames.family(F.col("pulse_set"))).where("family IS NOT NULL AND animal IS NOT NULL")
    several = F.count("*").over(Window.partitionBy("animal", "family")) > 1
    rows = rows.withColumn("processed", several & (F.col("family") != "pupil"))
    listed = F.posexplode_outer(null_if_empty(F.col("pulses"))).alias("at", "raw_pulse")
    long = rows.select("animal", "tif", "treatment", "family", "processed", "trig_delay", "isi", F.coalesce(F.size("pulses"), F.lit(0)).alias("total_pulses"), listed)
    base = long.withColumns({"pulse": F.col("at") + 1, "base": stimnames.base_name(F.col("raw_pulse"))})
    parameters = by_family(F.col("family"), F.col("base"))
    return base.select("animal", "tif", "treatment", "family", "processed", "trig_delay", "isi", "total_pulses", "pulse", "raw_pulse", "base", *[v.alias(k) for k, v in parameters.items()])


def numbered_stimuli(table: DataFrame, parameters: list[str]) -> DataFrame:
    """The table with stim_id: distinct stimuli numbered from 1 in falling order of treatment and parameters, within each animal."""
    distinct = table.select("animal", "treatment", *parameters).distinct()
    order = Window.partitionBy("animal").orderBy(F.desc("treatment"), *[F.desc(c) for c in parameters])
    numbers = distinct.withColumn("stim_id", F.row_number().over(order))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("treatment", *parameters)]
    joined = table.alias("t").join(numbers.alias("n"), [F.col("t.animal") == F.col("n.animal"), *same])
    return joined.select("t.*", "n.stim_id")
