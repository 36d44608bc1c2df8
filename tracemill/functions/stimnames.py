"""Stimulus parameters out of structured pulse names, by capture groups alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a pulse set's name contains, and the family; the first that fits wins.
FAMILIES = {"PTinContrast": "CGC", "contrastChange": "dContrast", "BPN": "BPN", "spont": "Spont", "LED trigger": "pupil"}


def number(name: Column, pattern: str) -> Column:
    """The first group as a number, NULL where it is not found: an empty text is none. The pattern is matched once."""
    return F.regexp_extract(name, pattern, 1).try_cast("double")


def part(name: Column, pattern: str) -> Column:
    """The first group, NULL where it is not found; the pattern is matched once."""
    return F.get(F.filter(F.array(F.regexp_extract(name, pattern, 1)), lambda x: x != ""), F.lit(0))


def family(pulse_set: Column) -> Column:
    out = F.lit(None).cast("string")
    for part, label in reversed(FAMILIES.items()):
        out = F.when(pulse_set.contains(part), F.lit(label)).otherwise(out)
    return out


def base_name(name: Column) -> Column:
    """The name without a repetition number from 1 to 9 at its end."""
    return F.when(F.substring(name, -2, 1) == "_", F.regexp_replace(name, "_[1-9]$", "")).otherwise(name)


def width(text: Column) -> Column:
    """Distance of the two numbers of a range such as 50-60."""
    parts = F.split(text, "-")
    return F.abs(F.get(parts, F.lit(0)).try_cast("double") - F.get(parts, F.lit(1)).try_cast("double"))


def noise_burst(name: Column) -> dict[str, Column]:
    return {
        "onset_s": number(name, r"_(\d+(?:\.\d+)?)sOnset"),
        "db": number(name, r"_(\d+)dB"),
        "pulse_ms": number(name, r"_(\d+)msPulse"),
        "stim_ms": number(name, r"_(\d+)msTotal"),
        "band_khz": part(name, r"BPN_(\d+-\d+)kHz"),
    }


def silence(name: Column) -> dict[str, Column]:
    return {"stim_ms": number(name, r"_(\d+)msTotal")}


def pure_tone(name: Column) -> dict[str, Column]:
    """Frequency in Hz (or kHz after stim_), level, onset with 'pt' for the point, length."""
    khz = number(name, r"stim_(\d{1,2})kHz_")
    onset = F.regexp_replace(F.regexp_extract(name, r"_at_(\d(?:pt\d)?)s", 1), "pt", ".")
    return {
        "freq_hz": F.coalesce(number(name, r"(\d{4,5})Hz"), khz * 1000),
        "db": number(name, r"_(\d{1,2})dB_\d{2,3}ms_at"),
        "onset_s": onset.try_cast("double"),
        "tone_ms": number(name, r"(\d{2,3})ms_at"),
    }


def noise_contrast(name: Column) -> dict[str, Column]:
    """Level range and its width, band (5-25 for the two old ranges without one), chord and total length (twice for sEach)."""
    levels = part(name, r"(\d{2}-\d{2})dB")
    band = part(name, r"_(\d-\d{2})kHz")
    total = number(name, r"_(\d{1,2})s_")
    return {
        "range_db": levels,
        "delta_db": width(levels),
        "band_khz": F.coalesce(band, F.when(levels.isin("45-55", "35-65"), F.lit("5-25"))),
        "chord_ms": number(name, r"(\d+)msDRC"),
        "total_s": total * F.when(name.contains("sEach"), 2).otherwise(1),
    }


def contrast_change(name: Column) -> dict[str, Column]:
    """All level ranges of a name, and whether the second is the wider one."""
    ranges = F.regexp_extract_all(name, F.lit(r"(\d{2}-\d{2})dB"), 1)
    first, second = width(F.get(ranges, F.lit(0))), width(F.get(ranges, F.lit(1)))
    return {"ranges_db": F.array_join(ranges, ","), "first_db": first, "second_db": second, "increase": second > first}


def map_tone(name: Column) -> dict[str, Column]:
    return {
        "freq_hz": number(name, r"(\d{4,5})Hz_"),
        "db": number(name, r"_(\d{2})dB_"),
        "onset_s": number(name, r"_at_(\d(?:\.\d)?)s_"),
        "pulse_ms": number(name, r"_(\d+)msPulse_"),
        "stim_ms": number(name, r"_(\d+)msTotal_"),
        "ramp_ms": number(name, r"_(\d+)msRamp_"),
        "rate_khz": number(name, r"_Fs(\d+)kHz"),
    }


def animal(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"([A-Z]{2}\d{4})", 1), F.lit(""))


def companion(name: Column, ending: str) -> Column:
    """Another file of a recording, such as its pulses."""
    return F.regexp_replace(name, r"\.tif$", ending)


def without_phase(treatment: Column) -> Column:
    return F.regexp_replace(treatment, "(pre|post)", "")
