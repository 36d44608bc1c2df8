"""Trace analyses. Events play long traces (cell = user, stimulus = event type); embeddings play traces held as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import arrays
from tracemill.functions.nulls import sem
from tracemill.jobs.registry import query, r6, rounded, table
from tracemill.operators import relations, traces

CELL = ["cell", "stim"]
TV = """tv AS (SELECT user_id AS cell, event_type AS stim, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS frame, value AS f FROM events)"""
DFF = (
    TV
    + """, based AS (SELECT *, avg(f) FILTER (frame <= 2) OVER w AS f0, count(f) FILTER (frame <= 2) OVER w AS nb FROM tv WINDOW w AS (PARTITION BY cell, stim)),
dff AS (SELECT cell, stim, frame, CASE WHEN nb = 2 THEN (f - f0) / nullif(f0, 0) END AS dff FROM based)"""
)
PEAKS = (
    DFF
    + """, found AS (SELECT cell, stim, max(dff) FILTER (frame BETWEEN 2 AND 4) AS pk, avg(dff) FILTER (frame <= 2) AS m, count(dff) FILTER (frame <= 2) AS nb, stddev_samp(dff) FILTER (frame <= 2) AS s FROM dff GROUP BY ALL),
judged AS (SELECT f.cell, f.stim, pk, nullif(m + 2 * CASE WHEN nb = 1 THEN 0 ELSE s END, 0) AS threshold, (SELECT min(frame) - 1 FROM dff d WHERE d.cell = f.cell AND d.stim = f.stim AND d.frame BETWEEN 2 AND 4 AND d.dff = pk) AS idx FROM found f)"""
)
EMB = "emb AS (SELECT vec_id, label, i AS frame, embedding[i]::DOUBLE AS f FROM embeddings, range(1, 65) t(i))"


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("stim"), "ts", "event_id", "value")
    return traces.numbered_frames(events, CELL, ["ts", "event_id"], "value")


def array_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("trace"))


def event_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = traces.relative_change(event_traces(spark, sf_dir), CELL, 1, 2)
    return traces.peaks(change, CELL, "dff", 2, 3)


@query(f"WITH {DFF} SELECT cell, stim, frame, frame / 5.0::DOUBLE - 1.0::DOUBLE AS t, round(dff, 6) + 0.0 AS dff FROM dff")
def dff_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dF/F of every trace, with frame times at 5 Hz and a trigger delay of 1 s."""
    change = traces.relative_change(event_traces(spark, sf_dir), CELL, 1, 2)
    return change.select(*CELL, "frame", (F.col("frame") / F.lit(5.0) - F.lit(1.0)).alias("t"), r6(F.col("dff")).alias("dff"))


@query(f"WITH {PEAKS} SELECT cell, stim, round(pk, 6) + 0.0 AS pk, idx, round(threshold, 6) + 0.0 AS threshold, coalesce(pk >= threshold, false) AS sig FROM judged")
def pk_resp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak response of every cell and stimulus, its frame in the window, threshold and significance."""
    found = event_peaks(spark, sf_dir)
    return rounded(found.withColumn("idx", F.col("idx").cast("long")), "pk", "threshold")


@query(f"WITH {PEAKS}, sigs AS (SELECT stim, pk FROM judged WHERE coalesce(pk >= threshold, false)) SELECT stim, count(*) AS n, round(avg(pk), 6) + 0.0 AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(pk) / sqrt(count(*)) END, 6) + 0.0 AS sem FROM sigs GROUP BY stim")
def stim_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and SEM of the significant peaks of each stimulus."""
    found = traces.mean_and_sem(event_peaks(spark, sf_dir).where("sig"), ["stim"], F.col("pk"))
    return rounded(found, "mean", "sem")


@query(f"WITH {EMB} SELECT label, frame, count(f) AS n, round(avg(f), 6) + 0.0 AS mean FROM emb GROUP BY ALL")
def trial_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over repetitions of each stimulus, frame by frame; frames are averaged in long form, so no group is ever held."""
    long = traces.exploded(array_traces(spark, sf_dir), ["label", "vec_id"], "trace")
    return long.groupBy("label", F.col("frame").cast("long").alias("frame")).agg(F.count("f").alias("n"), r6(F.avg("f")).alias("mean"))


@query(f"WITH {DFF}, cells AS (SELECT stim, frame, cell, avg(dff) AS m FROM dff GROUP BY ALL) SELECT stim, frame, count(m) AS n, round(100 * avg(m), 6) + 0.0 AS mean, round(100 * CASE WHEN count(m) = 1 THEN 0 ELSE stddev_samp(m) / sqrt(count(m)) END, 6) + 0.0 AS sem FROM cells GROUP BY ALL")
def pop_mean_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population trace in percent: cells first, then mean and SEM over cells."""
    change = traces.relative_change(event_traces(spark, sf_dir), CELL, 1, 2)
    found = traces.two_level(change, ["cell"], ["stim", "frame"], F.col("dff") * 100)
    return rounded(found, "mean", "sem")


@query(f"WITH {DFF} SELECT cell, stim, round(avg(dff) FILTER (frame / 5.0 - 1.0 BETWEEN -0.7 AND -0.1), 6) + 0.0 AS early, round(avg(dff) FILTER (frame / 5.0 - 1.0 BETWEEN 0.1 AND 0.9), 6) + 0.0 AS late FROM dff GROUP BY ALL")
def epoch_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean dF/F of two epochs of each trace."""
    change = traces.relative_change(event_traces(spark, sf_dir), CELL, 1, 2)
    found = traces.epoch_means(change, CELL, F.col("dff"), F.col("frame") / F.lit(5.0) - F.lit(1.0), {"early": (-0.7, -0.1), "late": (0.1, 0.9)})
    return rounded(found, "early", "late")


@query(f"WITH {EMB} SELECT vec_id, (frame - 5) // 15 + 1 AS pulse, (frame - 5) % 15 + 1 AS seg_frame, round(f, 6) + 0.0 AS f FROM emb WHERE frame > 4")
def pulse_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces cut to four segments of 15 frames after the first four."""
    cut = array_traces(spark, sf_dir).select("vec_id", F.posexplode(arrays.segments(F.col("trace"), 4, 15, 4)).alias("k", "segment"))
    long = cut.select("vec_id", (F.col("k") + 1).cast("long").alias("pulse"), F.posexplode("segment").alias("at", "f"))
    return long.select("vec_id", "pulse", (F.col("at") + 1).cast("long").alias("seg_frame"), r6(F.col("f")).alias("f"))


@query(
    f"WITH {EMB}, onset AS (SELECT *, 6 + label % 4 AS onset FROM emb) SELECT label, frame - (onset - 6) AS aligned, round(avg(f), 6) + 0.0 AS f FROM onset WHERE frame > onset - 6 AND frame - (onset - 6) <= 64 - 9 + 6 GROUP BY ALL"
)
def onset_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces aligned at onsets that differ by stimulus (frames 6 to 9), averaged by stimulus."""
    rows = array_traces(spark, sf_dir).withColumn("onset", 6 + F.col("label") % 4)
    cut = rows.select("label", "vec_id", arrays.onset_aligned(F.col("trace"), F.col("onset"), F.lit(6), F.lit(9)).alias("trace"))
    long = traces.exploded(cut, ["label", "vec_id"], "trace")
    return long.groupBy("label", F.col("frame").cast("long").alias("aligned")).agg(r6(F.avg("f")).alias("f"))


@query(
    f"""WITH {EMB}, o AS (SELECT *, label % 3 AS sound, 6 + label % 4 AS onset FROM emb), c AS (SELECT sound, onset, vec_id, frame - (onset - 4) AS k, f, 64 - (onset - 4) AS n FROM o WHERE frame > onset - 4),
m AS (SELECT min(n) AS least FROM c) SELECT sound, min(onset) OVER (PARTITION BY sound) AS onset, vec_id, k AS frame, round(f, 6) + 0.0 AS f FROM c, m WHERE k <= least"""
)
def onset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of one sound with different onsets, as repetitions of the earliest, cut to a common length."""
    rows = array_traces(spark, sf_dir).select((F.col("label") % 3).alias("sound"), (6 + F.col("label") % 4).alias("onset"), "vec_id", "trace")
    merged = traces.merged_onsets(rows, ["sound"], "onset", "trace", F.lit(4))
    long = merged.select("sound", "onset", "vec_id", F.posexplode("trace").alias("at", "f"))
    return long.select("sound", "onset", "vec_id", (F.col("at") + 1).cast("long").alias("frame"), r6(F.col("f")).alias("f"))


@query(f"WITH {EMB}, b AS (SELECT *, avg(f) FILTER (frame BETWEEN 5 AND 10) OVER (PARTITION BY vec_id) AS base FROM emb) SELECT vec_id, label, round(max(f - base) FILTER (frame BETWEEN 11 AND 14), 6) + 0.0 AS pk, round(avg(f - base) FILTER (frame BETWEEN 20 AND 30), 6) + 0.0 AS late FROM b GROUP BY ALL")
def additive_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak and late mean of each trial less its own baseline, all inside the array."""
    rows = array_traces(spark, sf_dir).withColumn("trace", arrays.less_mean(F.col("trace"), 5, 6))
    return rows.select("vec_id", "label", r6(F.array_max(F.slice("trace", 11, 4))).alias("pk"), r6(arrays.mean_of(F.slice("trace", 20, 11))).alias("late"))


@query(
    f"""WITH {EMB}, b AS (SELECT *, 1 + f AS g FROM emb), f0 AS (SELECT vec_id, avg(g) AS f0 FROM b WHERE frame <= 5 GROUP BY 1), d AS (SELECT b.vec_id, label, frame, (g - f0) / nullif(f0, 0) AS v FROM b JOIN f0 USING (vec_id)),
s AS (SELECT vec_id, label, max(v) FILTER (frame BETWEEN 6 AND 9) AS pk, nullif(avg(v) FILTER (frame <= 6) + 2 * stddev_samp(v) FILTER (frame <= 6), 0) AS threshold FROM d GROUP BY ALL)
SELECT s.vec_id, s.label, round(pk, 6) + 0.0 AS pk, (SELECT min(frame) - 5 FROM d WHERE d.vec_id = s.vec_id AND frame BETWEEN 6 AND 9 AND v = pk) AS idx, round(threshold, 6) + 0.0 AS threshold, coalesce(pk >= threshold, false) AS sig FROM s"""
)
def array_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dF/F and peak of every trial by the array kernels."""
    lifted = F.transform("trace", lambda v: v + 1)
    rows = array_traces(spark, sf_dir).withColumn("dff", arrays.dff(lifted, 1, 5))
    found = rows.withColumn("p", arrays.peak(F.col("dff"), 6, 4))
    return found.select("vec_id", "label", r6(F.col("p.pk")).alias("pk"), F.col("p.idx").cast("long").alias("idx"), r6(F.col("p.threshold")).alias("threshold"), F.col("p.sig").alias("sig"))


@query(
    """WITH e AS (SELECT vec_id, label, embedding AS m FROM embeddings), p AS (SELECT e.vec_id, e.label, i, e.m[i]::DOUBLE AS m, s.m[i]::DOUBLE AS s FROM e JOIN e s ON s.vec_id = e.vec_id - e.vec_id % 10, range(1, 65) t(i))
SELECT vec_id, label, i AS frame, round(m - 0.8 * (m - s), 6) + 0.0 AS f FROM p"""
)
def surround_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trace with four fifths of what exceeds its surround (the trace of its group of ten) taken out; every trace must have one."""
    rows = array_traces(spark, sf_dir).withColumn("group", F.col("vec_id") - F.col("vec_id") % 10)
    surround = array_traces(spark, sf_dir).where("vec_id % 10 = 0").select(F.col("vec_id").alias("group"), F.col("trace").alias("surround"))
    relations.require_partners(rows, surround, ["group"])
    both = rows.join(surround, "group").select("vec_id", "label", arrays.scaled(F.col("trace"), F.col("surround")).alias("trace"))
    return both.select("vec_id", "label", F.posexplode("trace").alias("at", "f")).select("vec_id", "label", (F.col("at") + 1).cast("long").alias("frame"), r6(F.col("f")).alias("f"))


@query(
    """WITH f AS (SELECT vec_id, label, [x > 0 FOR x IN embedding] AS up FROM embeddings), r AS (SELECT vec_id, label, i, up[i] AS b, i - row_number() OVER (PARTITION BY vec_id, up[i] ORDER BY i) AS island FROM f, range(1, 65) t(i)),
g AS (SELECT vec_id, island, count(*) AS n FROM r WHERE b GROUP BY ALL), first AS (SELECT vec_id, min(i) AS first FROM r WHERE b GROUP BY ALL) SELECT l.vec_id, coalesce((SELECT max(n) FROM g WHERE g.vec_id = l.vec_id), 0)::INT AS longest, first FROM embeddings l LEFT JOIN first USING (vec_id)"""
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of positive frames of each trace and its first positive frame."""
    up = F.transform("trace", lambda v: v > 0)
    return array_traces(spark, sf_dir).select("vec_id", arrays.longest_run(up).alias("longest"), arrays.first_frame(up).alias("first"))


@query(
    """WITH e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS f FROM embeddings, range(1, 65) t(i)), s AS (SELECT vec_id, min(f) AS lo, max(f) AS hi FROM e GROUP BY 1)
SELECT e.vec_id, round(avg((f - lo) / nullif(hi - lo, 0)), 6) + 0.0 AS shifted, round(avg((f - lo) / nullif(hi, 0)), 6) + 0.0 AS plain FROM e JOIN s USING (vec_id) GROUP BY 1"""
)
def unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each trace scaled to 0..1, and by its plain maximum."""
    return array_traces(spark, sf_dir).select("vec_id", r6(arrays.mean_of(arrays.zero_to_one(F.col("trace")))).alias("shifted"), r6(arrays.mean_of(arrays.zero_to_one(F.col("trace"), shifted=False))).alias("plain"))


@query(
    f"WITH {EMB}, w AS (SELECT vec_id, label, avg(f) FILTER (frame / 10.0 - 2 BETWEEN 0 AND 1) AS by_delay, avg(f) FILTER ((frame - 1) / 10.0 BETWEEN 0 AND 1) AS from_zero FROM emb GROUP BY ALL) SELECT label, round(avg(by_delay), 6) + 0.0 AS by_delay, round(avg(from_zero), 6) + 0.0 AS from_zero FROM w GROUP BY label"
)
def frame_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of one second under the two ways of counting frame times."""
    rows = array_traces(spark, sf_dir)
    n, rate = F.size("trace"), F.lit(10.0)
    a = arrays.window_mean(F.col("trace"), arrays.frame_times(n, rate, 2.0), 0.0, 1.0)
    b = arrays.window_mean(F.col("trace"), arrays.frame_times_from_zero(n, rate), 0.0, 1.0)
    return rows.select("label", a.alias("a"), b.alias("b")).groupBy("label").agg(r6(F.avg("a")).alias("by_delay"), r6(F.avg("b")).alias("from_zero"))


@query(
    f"""WITH {TV}, s AS (SELECT cell, stim, avg(f) FILTER (frame <= 2) AS f0, avg(f) FILTER (frame BETWEEN 3 AND 4) AS base2, max(f) FILTER (frame BETWEEN 5 AND 8) AS top FROM tv GROUP BY ALL),
p AS (SELECT cell, stim, (top - f0) / nullif(f0, 0) - (base2 - f0) / nullif(f0, 0) AS additive, (top - base2) / nullif(base2, 0) AS divisive FROM s) SELECT stim, count(additive) AS n, round(avg(additive), 6) + 0.0 AS additive, round(avg(divisive), 6) + 0.0 AS divisive FROM p GROUP BY stim"""
)
def second_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response over a second baseline, subtracted from dF/F or dividing the raw trace."""
    x = F.col("f")
    within = lambda a, b: F.when(F.col("frame").between(a, b), x)
    s = event_traces(spark, sf_dir).groupBy(*CELL).agg(F.avg(within(1, 2)).alias("f0"), F.avg(within(3, 4)).alias("base2"), F.max(within(5, 8)).alias("top"))
    change = lambda v: F.try_divide(F.col(v) - F.col("f0"), F.col("f0"))
    p = s.select("stim", (change("top") - change("base2")).alias("additive"), F.try_divide(F.col("top") - F.col("base2"), F.col("base2")).alias("divisive"))
    return p.groupBy("stim").agg(F.count("additive").alias("n"), r6(F.avg("additive")).alias("additive"), r6(F.avg("divisive")).alias("divisive"))


@query(f"WITH {PEAKS}, s AS (SELECT stim, cell FROM judged WHERE coalesce(pk >= threshold, false)) SELECT d.stim, d.frame, count(dff) AS n, round(avg(dff), 6) + 0.0 AS mean, round(CASE WHEN count(dff) = 1 THEN 0 ELSE stddev_samp(dff) / sqrt(count(dff)) END, 6) + 0.0 AS sem FROM dff d SEMI JOIN s ON s.stim = d.stim AND s.cell = d.cell GROUP BY ALL")
def significant_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean trace of the trials with a significant peak alone."""
    change = traces.relative_change(event_traces(spark, sf_dir), CELL, 1, 2)
    kept = change.join(traces.peaks(change, CELL, "dff", 2, 3).where("sig").select(*CELL), CELL, "left_semi")
    return kept.groupBy("stim", "frame").agg(F.count("dff").alias("n"), r6(F.avg("dff")).alias("mean"), r6(sem(F.col("dff"))).alias("sem"))
