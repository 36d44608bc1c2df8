"""Response grids and rate-level functions. Line items play trials: cell = supplier, level = line number, frequency = ship month."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.jobs.registry import query, rounded, table
from tracemill.operators import grids, statistics

CELL = ["cell"]
TRIALS = "trials AS (SELECT l_suppkey AS cell, l_linenumber AS db, month(l_shipdate) AS freq, l_extendedprice AS pk, l_discount > 0.05 AS sig FROM lineitem)"
GRID = (
    TRIALS
    + """, seen AS (SELECT cell, db, freq, avg(pk) AS pk, avg(CASE WHEN sig THEN nullif(pk * pk, 0) END) AS sig_pk FROM trials GROUP BY ALL),
axes AS (SELECT a.cell, db, freq FROM (SELECT DISTINCT cell, db FROM trials) a JOIN (SELECT DISTINCT cell, freq FROM trials) b USING (cell)),
grid AS (SELECT a.cell, a.db, a.freq, pk, sig_pk FROM axes a LEFT JOIN seen s ON a.cell = s.cell AND a.db = s.db AND a.freq = s.freq)"""
)
SPARSE = "trials AS (SELECT l_suppkey AS cell, l_linenumber AS db, avg(l_extendedprice) AS pk, bool_or(l_discount > 0.095 AND l_tax > 0.055) AS sig FROM lineitem GROUP BY ALL)"
CURVES = SPARSE + ", curves AS (SELECT c.cell, d.db, t.pk, coalesce(t.sig, false) AS sig FROM (SELECT DISTINCT cell FROM trials) c CROSS JOIN (SELECT DISTINCT db FROM trials) d LEFT JOIN trials t ON t.cell = c.cell AND t.db = d.db)"
CELLS = (
    CURVES
    + """, isl AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY db) - row_number() OVER (PARTITION BY cell, sig ORDER BY db) AS k FROM curves),
runs AS (SELECT cell, count(*) AS n FROM isl WHERE sig GROUP BY cell, k), longest AS (SELECT cell, max(n) AS n FROM runs GROUP BY cell),
cells AS (SELECT c.cell, coalesce(max(l.n), 0) >= 3 AS included, CASE WHEN coalesce(max(l.n), 0) >= 3 THEN min(db) FILTER (c.sig) END::DOUBLE AS threshold, count(*) FILTER (c.sig) AS n_sig FROM curves c LEFT JOIN longest l USING (cell) GROUP BY c.cell)"""
)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("db"), F.month("l_shipdate").alias("freq"), F.col("l_extendedprice").alias("pk"), (F.col("l_discount") > 0.05).alias("sig"))


def level_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trials with a stricter significance, so that some cells fail."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("db"), F.col("l_extendedprice").alias("pk"), ((F.col("l_discount") > 0.095) & (F.col("l_tax") > 0.055)).alias("sig"))


@query(f"WITH {GRID} SELECT cell, db, freq::INT AS freq, round(pk, 6) + 0.0 AS pk, round(sig_pk, 2) + 0.0 AS sig_pk FROM grid")
def fra_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell's grid of mean and mean significant responses, missing pairs as NULL."""
    return rounded(rounded(grids.response_grid(trials(spark, sf_dir), CELL), "pk"), "sig_pk", digits=2)


@query(f"WITH {GRID}, curve AS (SELECT cell, freq, avg(sig_pk) AS r FROM grid GROUP BY ALL) SELECT cell, coalesce(arg_max(freq, r), min(freq))::INT AS bf FROM (SELECT * FROM curve ORDER BY cell, freq) GROUP BY cell")
def fra_bf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best frequency of each cell."""
    return grids.best_frequency(grids.response_grid(trials(spark, sf_dir), CELL), CELL)


@query(
    f"""WITH {GRID}, ax AS (SELECT cell, sig_pk AS v, dense_rank() OVER (PARTITION BY cell ORDER BY db) AS i, dense_rank() OVER (PARTITION BY cell ORDER BY freq) AS j FROM grid),
top AS (SELECT cell, i AS ti, j AS tj FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v DESC NULLS LAST, j, i) AS k FROM ax WHERE v IS NOT NULL) WHERE k = 1)
SELECT a.cell, round(avg(v) FILTER (abs(i - ti) + abs(j - tj) <= 1) - avg(v), 2) + 0.0 AS dprime FROM ax a LEFT JOIN top USING (cell) GROUP BY a.cell"""
)
def fra_dprime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectivity of each cell: its peak's neighbourhood less the mean of its grid."""
    return rounded(grids.selectivity(grids.response_grid(trials(spark, sf_dir), CELL), CELL), "dprime", digits=2)


def poisson_sql(share: str, rate: str, most: int = 7) -> str:
    """How many of the first cumulative chances of a Poisson number lie at or below ``share``."""
    terms = [f"({share} >= exp(-{rate}) * (" + " + ".join(f"{rate} ** {j} / {math.factorial(j)}" for j in range(k)) + "))::INT" for k in range(1, most + 1)]
    return "(" + " + ".join(terms) + ")"


@query(
    f"""WITH {GRID}, ax AS (SELECT cell, sig_pk AS v, dense_rank() OVER (PARTITION BY cell ORDER BY db) AS i, dense_rank() OVER (PARTITION BY cell ORDER BY freq) AS j, count(*) OVER (PARTITION BY cell) AS n FROM grid),
top AS (SELECT cell, i AS ti, j AS tj FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v DESC NULLS LAST, j, i) AS k FROM ax WHERE v IS NOT NULL) WHERE k = 1),
sized AS (SELECT a.*, avg(v) FILTER (abs(i - ti) + abs(j - tj) <= 1) OVER w AS around, (count(*) FILTER (abs(i - ti) + abs(j - tj) <= 1) OVER w)::DOUBLE / n AS rate FROM ax a LEFT JOIN top USING (cell) WINDOW w AS (PARTITION BY a.cell)),
u AS (SELECT *, ('0x' || substr(md5(cell || ':' || i || ':' || j || ':' || r), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS share FROM sized, range(1, 101) q(r) WHERE v IS NOT NULL),
draw AS (SELECT *, {poisson_sql("share", "rate")} AS times FROM u),
d AS (SELECT cell, r, max(around) - sum(times * v) / nullif(sum(times), 0) AS d FROM draw GROUP BY ALL HAVING sum(times) > 0)
SELECT cell, count(*) AS rounds, round(avg(d), 2) + 0.0 AS dprime, round(stddev_samp(d), 2) + 0.0 AS se, round(quantile_cont(d, 0.025), 2) + 0.0 AS low, round(quantile_cont(d, 0.975), 2) + 0.0 AS high FROM d GROUP BY cell"""
)
def fra_dprime_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectivity of each cell against a hundred rounds of random draws, with what 95 % of the rounds hold."""
    return rounded(grids.resampled_selectivity(grids.response_grid(trials(spark, sf_dir), CELL), CELL), "dprime", "se", "low", "high", digits=2)


@query(f"WITH {GRID}, p AS (SELECT db, freq, avg(sig_pk) AS r FROM grid GROUP BY ALL) SELECT freq::INT AS freq, round(avg(r), 2) + 0.0 AS r FROM p GROUP BY freq")
def fra_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuning curve over all cells."""
    return rounded(grids.tuning_curve(grids.response_grid(trials(spark, sf_dir), CELL), CELL), "r", digits=2)


@query(f"WITH {GRID} SELECT cell, db, freq::INT AS freq, round(pk, 6) + 0.0 AS pk FROM grid WHERE db IN (2, 4, 6) OR (SELECT count(DISTINCT db) FROM grid g WHERE g.cell = grid.cell) <= 3")
def fra_three_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense grids cut to three levels."""
    grid = grids.three_levels(grids.response_grid(trials(spark, sf_dir), CELL), CELL, (2, 4, 6))
    return rounded(grid.select("cell", "db", "freq", "pk"), "pk")


@query(f"WITH {CURVES} SELECT cell, db, round(pk, 6) + 0.0 AS pk, sig FROM curves")
def rlf_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-level function of every cell on one axis of levels."""
    return rounded(grids.level_functions(level_trials(spark, sf_dir), CELL), "pk")


@query(f"WITH {CELLS} SELECT * FROM cells")
def rlf_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells respond at three levels in a row, and from which level on."""
    found = grids.responsive_cells(grids.level_functions(level_trials(spark, sf_dir), CELL), CELL)
    return found.withColumn("threshold", F.col("threshold").cast("double"))


@query(f"WITH {CELLS} SELECT db, count(pk) AS n, round(avg(pk), 6) + 0.0 AS mean, round(CASE WHEN count(pk) = 1 THEN 0 ELSE stddev_samp(pk) / sqrt(count(pk)) END, 6) + 0.0 AS sem FROM curves SEMI JOIN (SELECT cell FROM cells WHERE included) i USING (cell) GROUP BY db")
def rlf_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rate-level function of the included cells."""
    curves = grids.level_functions(level_trials(spark, sf_dir), CELL)
    return rounded(grids.cohort_curve(curves, grids.responsive_cells(curves, CELL), CELL), "mean", "sem")


@query(f"WITH {TRIALS}, b AS (SELECT cell, freq, avg(pk) FILTER (db = 1) AS lo, avg(pk) FILTER (db = 3) AS hi FROM trials GROUP BY ALL), r AS (SELECT freq, lo / nullif(hi, 0) AS ratio FROM b) SELECT freq::INT AS freq, count(ratio) AS n, round(avg(ratio), 6) + 0.0 AS mean, round(CASE WHEN count(ratio) = 1 THEN 0 ELSE stddev_samp(ratio) / sqrt(count(ratio)) END, 6) + 0.0 AS sem FROM r GROUP BY freq")
def ratio_lohi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of the responses at a low and a high level, cells matched by key, by frequency."""
    from tracemill.operators.traces import mean_and_sem

    pairs = grids.low_over_high(trials(spark, sf_dir), ["cell", "freq"], F.col("db"), 1, 3, F.col("pk"))
    return rounded(mean_and_sem(pairs, ["freq"], F.col("ratio")), "mean", "sem")


@query(f"WITH {TRIALS}, b AS (SELECT cell, freq, avg(pk) FILTER (db = 1) AS lo, avg(pk) FILTER (db = 3) AS hi FROM trials GROUP BY ALL) SELECT freq::INT AS freq, count(*) FILTER (lo > hi) AS lower, count(*) FILTER (hi > lo) AS higher, count(*) FILTER (lo IS NOT NULL AND hi IS NOT NULL) AS complete FROM b GROUP BY freq")
def prepost_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells go up or down between two conditions, of those that have both."""
    pairs = grids.low_over_high(trials(spark, sf_dir), ["cell", "freq"], F.col("db"), 1, 3, F.col("pk"))
    return pairs.groupBy("freq").agg(F.count_if(F.col("lo") > F.col("hi")).alias("lower"), F.count_if(F.col("hi") > F.col("lo")).alias("higher"), F.count_if(F.col("lo").isNotNull() & F.col("hi").isNotNull()).alias("complete"))


@query(
    f"""WITH {GRID}, curve AS (SELECT cell, freq, avg(sig_pk) AS r FROM grid GROUP BY ALL), bf AS (SELECT cell, coalesce(arg_max(freq, r), min(freq)) AS bf FROM (SELECT * FROM curve ORDER BY cell, freq) GROUP BY cell)
SELECT t.cell, abs(log2(t.freq / b.bf)) > 1 AS outside_octave, count(*) AS n, round(avg(pk), 4) + 0.0 AS mean FROM trials t JOIN bf b USING (cell) GROUP BY ALL"""
)
def octave_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses within and outside one octave of each cell's best frequency."""
    from tracemill.functions.arrays import octaves

    rows = trials(spark, sf_dir)
    bf = grids.best_frequency(grids.response_grid(rows, CELL), CELL)
    outside = F.abs(octaves(F.col("bf"), F.col("freq"))) > 1
    return rows.join(bf, "cell").groupBy("cell", outside.alias("outside_octave")).agg(F.count("*").alias("n"), F.round(F.avg("pk"), 4).alias("mean"))


@query(
    f"""WITH {TRIALS}, s AS (SELECT cell, avg(pk) FILTER (db = 1 AND freq <= 6) AS a, avg(pk) FILTER (db = 1 AND freq > 6) AS b, avg(pk) FILTER (db = 3 AND freq <= 6) AS c, avg(pk) FILTER (db = 3 AND freq > 6) AS d FROM trials GROUP BY cell),
e AS (SELECT unnest(['contrast', 'interaction', 'phase']) AS effect, unnest([(c + d) - (a + b), (d - c) - (b - a), (b + d) - (a + c)]) AS score FROM s)
SELECT effect, count(score) AS n, round(power(avg(score) / (stddev_samp(score) / sqrt(count(score))), 2), 6) + 0.0 AS f, count(score) - 1 AS df FROM e GROUP BY effect"""
)
def rm_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-by-two repeated-measures analysis of variance over cells: contrast (level) by phase (half year)."""
    early, level = F.col("freq") <= 6, F.col("db")
    mean = lambda test: F.avg(F.when(test, F.col("pk")))
    s = trials(spark, sf_dir).groupBy("cell").agg(mean((level == 1) & early).alias("a"), mean((level == 1) & ~early).alias("b"), mean((level == 3) & early).alias("c"), mean((level == 3) & ~early).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    found = statistics.paired_effects(s, [], {"contrast": (c + d) - (a + b), "phase": (b + d) - (a + c), "interaction": (d - c) - (b - a)})
    return rounded(found, "f")
