"""Whole analyses from traces to a table of cells, on embeddings as recordings of 64 frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.jobs.registry import query, r6, rounded
from tracemill.jobs.trace_jobs import EMB, array_traces
from tracemill.operators import alignment, relations


@query(
    """WITH p AS (SELECT vec_id AS tif, label AS roi, k AS pulse, 'tone' || ((vec_id + k) % 4) AS stim, list_avg([x::DOUBLE FOR x IN embedding[5 + (k - 1) * 20 : 4 + k * 20]]) AS f FROM embeddings, range(1, 4) t(k)),
s AS (SELECT stim, row_number() OVER (ORDER BY stim DESC)::INT AS stim_id FROM (SELECT DISTINCT stim FROM p))
SELECT roi, stim_id, row_number() OVER (PARTITION BY roi, stim_id ORDER BY tif, pulse)::INT AS rep, round(f, 6) + 0.0 AS f FROM p JOIN s USING (stim)"""
)
def roi_stim_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pulses of each recording cut out, stimuli numbered, repetitions numbered by cell and stimulus."""
    rows = array_traces(spark, sf_dir).select(F.col("vec_id").alias("tif"), F.col("label").alias("roi"), "trace")
    names = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat(F.lit("tone"), ((F.col("tif") + k) % 4).cast("string")))
    pulses = alignment.pulses_of(rows.select("tif", names.alias("stim")), ["tif"], ["stim"])
    cut = alignment.pulse_traces(alignment.equalised(rows, ["roi"], "trace"), pulses, ["tif"], "trace", 4, 20)
    numbered = cut.join(relations.ordered_stimuli(pulses, ["stim"]), "stim")
    mean = F.aggregate("trace", F.lit(0.0), lambda acc, v: acc + v) / F.size("trace")
    return alignment.repetitions(numbered, ["roi"], ["stim_id"], ["tif", "pulse"]).select("roi", "stim_id", "rep", r6(mean).alias("f"))


@query(
    f"""WITH {EMB}, o AS (SELECT vec_id, label % 5 AS sound, 10 + 5 * (label % 3) AS onset, frame, 1 + f AS f FROM emb), b AS (SELECT *, avg(f) FILTER (frame BETWEEN onset - 9 AND onset) OVER (PARTITION BY vec_id) AS f0 FROM o),
d AS (SELECT sound, vec_id, frame - (onset - 10) AS k, (f - f0) / nullif(f0, 0) AS v, 64 - (onset - 10) AS n FROM b WHERE frame > onset - 10), m AS (SELECT sound, k, avg(v) AS f, count(v) AS reps FROM d WHERE k <= (SELECT min(n) FROM d) GROUP BY ALL),
p AS (SELECT sound, max(f) FILTER (k BETWEEN 10 AND 15) AS pk, avg(f) FILTER (k <= 10) + 2 * stddev_samp(f) FILTER (k <= 10) AS threshold, max(reps) AS n FROM m GROUP BY 1)
SELECT sound, n, round(pk, 6) + 0.0 AS pk, (SELECT min(k) - 9 FROM m WHERE m.sound = p.sound AND k BETWEEN 10 AND 15 AND f = pk) AS idx, round(threshold, 6) + 0.0 AS threshold, coalesce(pk >= nullif(threshold, 0), false) AS sig FROM p"""
)
def burst_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise bursts: dF/F, merged onsets, mean over repetitions, peak and significance of each sound."""
    rows = array_traces(spark, sf_dir).select("vec_id", (F.col("label") % 5).alias("sound"), (10 + 5 * (F.col("label") % 3)).alias("onset"), F.transform("trace", lambda v: v + 1).alias("trace"))
    found = alignment.noise_burst_peaks(rows, ["sound"], "onset", "trace", 10.0, 400.0)
    return rounded(found.withColumn("idx", F.col("idx").cast("long")), "pk", "threshold").select("sound", "n", "pk", "idx", "threshold", "sig")


@query(
    f"""WITH {EMB}, o AS (SELECT vec_id, label // 2 AS roi, CASE WHEN label % 2 = 0 THEN 10 ELSE 30 END AS contrast, frame, 1 + f AS f FROM emb), b AS (SELECT *, avg(f) FILTER (frame BETWEEN 5 AND 10) OVER (PARTITION BY vec_id) AS f0 FROM o),
d AS (SELECT *, (f - f0) / nullif(f0, 0) AS v FROM b WHERE frame >= 5), e AS (SELECT *, v - avg(v) FILTER (frame BETWEEN 21 AND 30) OVER (PARTITION BY vec_id) AS w FROM d), m AS (SELECT roi, contrast, frame, avg(w) AS f FROM e WHERE frame >= 21 GROUP BY ALL),
p AS (SELECT roi, contrast, max(f) FILTER (frame BETWEEN 31 AND 34) AS pk, avg(f) FILTER (frame <= 31) + 0.5 * stddev_samp(f) FILTER (frame <= 31) AS threshold FROM m GROUP BY ALL)
SELECT roi, round(max(pk) FILTER (contrast = 10), 6) + 0.0 AS low, round(max(pk) FILTER (contrast = 30), 6) + 0.0 AS high, bool_and(coalesce(pk >= nullif(threshold, 0), false)) AND count(*) = 2 AS all_sig FROM p GROUP BY roi"""
)
def contrast_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tones in contrast: two baselines, mean over repetitions, peaks by contrast, and cells that respond in both."""
    rows = array_traces(spark, sf_dir).select("vec_id", F.floor(F.col("label") / 2).cast("int").alias("roi"), F.when(F.col("label") % 2 == 0, 10).otherwise(30).alias("contrast"), F.transform("trace", lambda v: v + 1).alias("trace"))
    found = alignment.contrast_peaks(rows, ["roi"], "contrast", "trace", (5, 10), (21, 30), 21, 31, 4, 0.5)
    wide = alignment.responsive_in_all(found, ["roi"], "contrast", [10, 30])
    return rounded(wide.withColumnsRenamed({"10": "low", "30": "high"}), "low", "high")
