"""Stimulus names: built from the columns of parts and line items, and parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import stimnames
from tracemill.jobs.registry import query, table
from tracemill.operators import relations

N = "try_cast(nullif(regexp_extract(name, '{}', 1), '') AS DOUBLE)"


def num(pattern: str) -> str:
    return N.format(pattern)


def named(spark: SparkSession, sf_dir: str, *parts: str | Column) -> DataFrame:
    """(id, name): a name for each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]).alias("name"))


def part_columns() -> tuple[Column, Column]:
    """A part's key and size, of which names are made."""
    return F.col("p_partkey"), F.col("p_size")


@query(
    f"""WITH t AS (SELECT p_partkey AS id, 'BPN_' || (5 + p_partkey % 5) || '-' || (10 + p_size) || 'kHz_x_' || (10 + p_size) || 'dB_x_' || (100 * (1 + p_partkey % 4)) || 'msPulse_' || (500 + p_size) || 'msTotal_' || (1 + p_partkey % 3) || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END || 'sOnset' AS name FROM part)
SELECT id, {num(r'_(\d+(?:\.\d+)?)sOnset')} AS onset_s, {num(r'_(\d+)dB')} AS db, {num(r'_(\d+)msPulse')} AS pulse_ms, {num(r'_(\d+)msTotal')} AS stim_ms, nullif(regexp_extract(name, 'BPN_(\\d+-\\d+)kHz', 1), '') AS band_khz FROM t""".replace("\\\\d", "\\d")
)
def stim_parse_bpn(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = part_columns()
    rows = named(spark, sf_dir, "BPN_", 5 + key % 5, "-", 10 + size, "kHz_x_", 10 + size, "dB_x_", 100 * (1 + key % 4), "msPulse_", 500 + size, "msTotal_", 1 + key % 3, F.when(key % 2 == 0, ".5").otherwise(""), "sOnset")
    return rows.select("id", *[v.alias(k) for k, v in stimnames.noise_burst(F.col("name")).items()])


@query(
    f"""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '_stim_' || (1 + p_size) || 'kHz_' ELSE '_stim_' || (4000 + 10 * p_size) || 'Hz_' END || (20 + p_size) || 'dB_' || (100 + p_size) || 'ms_at_' || (p_partkey % 8) || CASE WHEN p_partkey % 2 = 0 THEN 'pt5' ELSE '' END || 's_2' AS name FROM part)
SELECT id, coalesce({num(r'(\d{4,5})Hz').replace('{', '{')}, 1000 * {num(r'stim_(\d{1,2})kHz_')}) AS freq_hz, {num(r'_(\d{1,2})dB_\d{2,3}ms_at')} AS db, try_cast(nullif(replace(regexp_extract(name, '_at_(\\d(?:pt\\d)?)s', 1), 'pt', '.'), '') AS DOUBLE) AS onset_s, {num(r'(\d{2,3})ms_at')} AS tone_ms FROM t""".replace("\\\\d", "\\d")
)
def stim_parse_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = part_columns()
    tone = F.when(key % 3 == 0, F.concat(F.lit("_stim_"), (1 + size).cast("string"), F.lit("kHz_"))).otherwise(F.concat(F.lit("_stim_"), (4000 + 10 * size).cast("string"), F.lit("Hz_")))
    rows = named(spark, sf_dir, tone, 20 + size, "dB_", 100 + size, "ms_at_", key % 8, F.when(key % 2 == 0, "pt5").otherwise(""), "s_2")
    return rows.select("id", *[v.alias(k) for k, v in stimnames.pure_tone(F.col("name")).items()])


DRC = "(CASE p_partkey % 3 WHEN 0 THEN '50-60' WHEN 1 THEN '40-70' ELSE '45-55' END)"
DELTA = "abs(try_cast(split_part({0}, '-', 1) AS DOUBLE) - try_cast(split_part({0}, '-', 2) AS DOUBLE))"


@query(
    f"""WITH t AS (SELECT p_partkey AS id, (20 + p_size) || 'msDRC' || CASE WHEN p_partkey % 2 = 0 THEN '_5-52kHz' ELSE '' END || '_' || {DRC} || 'dB_' || (1 + p_partkey % 12) || 's_' || CASE WHEN p_partkey % 5 = 0 THEN 'sEach' ELSE 'stim' END AS name FROM part),
p AS (SELECT *, nullif(regexp_extract(name, '(\\d{{2}}-\\d{{2}})dB', 1), '') AS range_db FROM t)
SELECT id, range_db, {DELTA.format('range_db')} AS delta_db, coalesce(nullif(regexp_extract(name, '_(\\d-\\d{{2}})kHz', 1), ''), CASE WHEN range_db IN ('45-55', '35-65') THEN '5-25' END) AS band_khz, {num(r'(\d+)msDRC')} AS chord_ms,
{num(r'_(\d{1,2})s_')} * CASE WHEN contains(name, 'sEach') THEN 2 ELSE 1 END AS total_s FROM p""".replace("\\\\d", "\\d")
)
def stim_parse_drc(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = part_columns()
    levels = F.when(key % 3 == 0, "50-60").when(key % 3 == 1, "40-70").otherwise("45-55")
    rows = named(spark, sf_dir, 20 + size, "msDRC", F.when(key % 2 == 0, "_5-52kHz").otherwise(""), "_", levels, "dB_", 1 + key % 12, "s_", F.when(key % 5 == 0, "sEach").otherwise("stim"))
    return rows.select("id", *[v.alias(k) for k, v in stimnames.noise_contrast(F.col("name")).items()])


@query(
    f"""WITH t AS (SELECT p_partkey AS id, (20 + p_size) || 'msDRC_5-52kHz_' || {DRC} || 'dB_to_' || (CASE p_partkey % 2 WHEN 0 THEN '50-60' ELSE '40-70' END) || 'dB_10s' AS name FROM part),
p AS (SELECT id, regexp_extract_all(name, '(\\d{{2}}-\\d{{2}})dB', 1) AS r FROM t)
SELECT id, array_to_string(r, ',') AS ranges_db, {DELTA.format('r[1]')} AS first_db, {DELTA.format('r[2]')} AS second_db, {DELTA.format('r[2]')} > {DELTA.format('r[1]')} AS increase FROM p""".replace("\\\\d", "\\d")
)
def stim_parse_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = part_columns()
    levels = F.when(key % 3 == 0, "50-60").when(key % 3 == 1, "40-70").otherwise("45-55")
    rows = named(spark, sf_dir, 20 + size, "msDRC_5-52kHz_", levels, "dB_to_", F.when(key % 2 == 0, "50-60").otherwise("40-70"), "dB_10s")
    return rows.select("id", *[v.alias(k) for k, v in stimnames.contrast_change(F.col("name")).items()])


@query(
    f"""WITH t AS (SELECT p_partkey AS id, 'x_' || (4000 + 1000 * (p_size % 30)) || 'Hz_' || (30 + 20 * (p_partkey % 3)) || 'dB_' || (100 * (1 + p_partkey % 4)) || 'msPulse_1000msTotal_' || (1 + p_size) || 'msRamp_at_' || (p_partkey % 3) || '.5s_Fs250kHz' AS name FROM part)
SELECT id, {num(r'(\d{4,5})Hz_')} AS freq_hz, {num(r'_(\d{2})dB_')} AS db, {num(r'_at_(\d(?:\.\d)?)s_')} AS onset_s, {num(r'_(\d+)msPulse_')} AS pulse_ms, {num(r'_(\d+)msTotal_')} AS stim_ms, {num(r'_(\d+)msRamp_')} AS ramp_ms, {num(r'_Fs(\d+)kHz')} AS rate_khz FROM t"""
)
def stim_parse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = part_columns()
    rows = named(spark, sf_dir, "x_", 4000 + 1000 * (size % 30), "Hz_", 30 + 20 * (key % 3), "dB_", 100 * (1 + key % 4), "msPulse_1000msTotal_", 1 + size, "msRamp_at_", key % 3, ".5s_Fs250kHz")
    return rows.select("id", *[v.alias(k) for k, v in stimnames.map_tone(F.col("name")).items()])


FAMILY = "CASE WHEN contains(pulseset, 'PTinContrast') THEN 'CGC' WHEN contains(pulseset, 'contrastChange') THEN 'dContrast' WHEN contains(pulseset, 'BPN') THEN 'BPN' WHEN contains(pulseset, 'spont') THEN 'Spont' WHEN contains(pulseset, 'LED trigger') THEN 'pupil' END"
SETS = "(CASE o_orderkey % 6 WHEN 0 THEN 'PTinContrast_v2' WHEN 1 THEN 'contrastChange sEach' WHEN 2 THEN 'BPN set' WHEN 3 THEN 'spont' WHEN 4 THEN 'LED trigger' ELSE 'other' END)"


def pulse_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(animal, tif, pulseset): one recording for each order."""
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, "PTinContrast_v2").when(k == 1, "contrastChange sEach").when(k == 2, "BPN set").when(k == 3, "spont").when(k == 4, "LED trigger").otherwise("other")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("animal"), F.col("o_orderkey").alias("tif"), name.alias("pulseset"))


@query(f"WITH s AS (SELECT o_custkey AS animal, {SETS} AS pulseset FROM orders), f AS (SELECT animal, {FAMILY} AS family FROM s) SELECT animal, family, count(*) AS n, count(*) > 1 AS processed FROM f WHERE family IS NOT NULL GROUP BY ALL")
def stim_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of each animal by stimulus family; families with more than one recording are processed."""
    rows = pulse_sets(spark, sf_dir).withColumn("family", stimnames.family(F.col("pulseset"))).where("family IS NOT NULL")
    return rows.groupBy("animal", "family").agg(F.count("*").alias("n"), (F.count("*") > 1).alias("processed"))


@query(
    """WITH n AS (SELECT l_orderkey AS tif, 'pulse_' || l_linenumber AS name FROM lineitem), c AS (SELECT tif, count(*) AS pulses, min(name) AS one, string_agg(name, ',' ORDER BY name) AS names FROM n GROUP BY tif)
SELECT tif, pulses, CASE WHEN pulses = 1 THEN regexp_replace(one, '_[1-9]$', '') ELSE names END AS names FROM c"""
)
def pulse_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulses of each recording; a single one loses its repetition number."""
    names = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tif"), F.concat(F.lit("pulse_"), F.col("l_linenumber")).alias("name"))
    found = names.groupBy("tif").agg(F.count("*").alias("pulses"), F.min("name").alias("one"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return found.select("tif", "pulses", F.when(F.col("pulses") == 1, stimnames.base_name(F.col("one"))).otherwise(F.col("names")).alias("names"))


@query(
    """WITH f AS (SELECT c_custkey AS id, '/data/AA' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '/rec_' || c_custkey || '.tif' AS path, CASE c_custkey % 3 WHEN 0 THEN 'preZX1' WHEN 1 THEN 'postZX1' ELSE 'none' END AS treatment FROM customer)
SELECT id, nullif(regexp_extract(path, '([A-Z]{2}\\d{4})', 1), '') AS animal, regexp_replace(path, '\\.tif$', '_Pulses.mat') AS pulses, regexp_replace(treatment, '(pre|post)', '', 'g') AS drug FROM f""".replace("\\\\", "\\")
)
def name_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animal, companion file and drug out of file names and treatments."""
    k = F.col("c_custkey")
    path = F.concat(F.lit("/data/AA"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("/rec_"), k.cast("string"), F.lit(".tif"))
    treatment = F.when(k % 3 == 0, "preZX1").when(k % 3 == 1, "postZX1").otherwise("none")
    return table(spark, sf_dir, "customer").select(k.alias("id"), stimnames.animal(path).alias("animal"), stimnames.companion(path, "_Pulses.mat").alias("pulses"), stimnames.without_phase(treatment).alias("drug"))


@query("SELECT p_type AS treatment, p_brand AS tone, p_size AS level, row_number() OVER (ORDER BY p_type DESC, p_brand DESC, p_size DESC)::INT AS stim_id FROM (SELECT DISTINCT p_type, p_brand, p_size FROM part)")
def stim_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stimuli, numbered."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("treatment"), F.col("p_brand").alias("tone"), F.col("p_size").alias("level"))
    return relations.ordered_stimuli(rows, ["treatment", "tone", "level"])
