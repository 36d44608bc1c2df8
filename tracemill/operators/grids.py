"""Response grids (level by frequency) and rate-level functions, for all cells at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.nulls import sem


def response_grid(trials: DataFrame, cell: list[str], squared: bool = True) -> DataFrame:
    """(cell, db, freq, pk, sig_pk) over each cell's full grid of the levels and frequencies that it has seen.

    sig_pk averages the significant trials alone, as the peak times itself if
    ``squared`` (what the grids of the cohort tables hold) or as the plain peak.
    Pairs that were never played are there with NULL. Axes are sets of what the
    aggregated pairs have, as many as levels and frequencies were played.
    """
    value = F.col("pk") * F.col("pk") if squared else F.col("pk")
    seen = trials.groupBy(*cell, "db", "freq").agg(F.avg("pk").alias("pk"), F.avg(F.when(F.col("sig"), F.nullif(value, F.lit(0.0)))).alias("sig_pk"))
    axes = seen.groupBy(*cell).agg(F.collect_set("db").alias("dbs"), F.collect_set("freq").alias("freqs"))
    full = axes.select(*cell, F.explode("dbs").alias("db"), "freqs").select(*cell, "db", F.explode("freqs").alias("freq"))
    return full.join(seen, [*cell, "db", "freq"], "left")


def best_frequency(grid: DataFrame, cell: list[str], value: str = "sig_pk") -> DataFrame:
    """(cell, bf): the frequency of the largest mean over levels; the lowest on ties or without any response."""
    curve = grid.groupBy(*cell, "freq").agg(F.avg(value).alias("r"))
    best = -F.max(F.when(F.col("r").isNotNull(), F.struct("r", (-F.col("freq")).alias("f"))))["f"]
    return curve.groupBy(*cell).agg(F.coalesce(best, F.min("freq")).alias("bf"))


def selectivity(grid: DataFrame, cell: list[str], value: str = "sig_pk") -> DataFrame:
    """(cell, dprime): mean of the largest response and its neighbours in level and frequency, less the mean of all.

    The closed form of a bootstrap that draws as many responses at random. Ties go
    to the lowest frequency, then level. NULL without any response. One window per
    cell numbers its axes and finds the peak; no grid is joined with itself.
    """
    own = Window.partitionBy(*cell)
    axes = grid.select(*cell, "db", "freq", F.col(value).alias("v"), F.dense_rank().over(own.orderBy("db")).alias("i"), F.dense_rank().over(own.orderBy("freq")).alias("j"))
    peak = F.max(F.when(F.col("v").isNotNull(), F.struct("v", (-F.col("j")).alias("j"), (-F.col("i")).alias("i")))).over(own)
    near = F.abs(F.col("i") + F.col("top.i")) + F.abs(F.col("j") + F.col("top.j")) <= 1
    return axes.withColumn("top", peak).groupBy(*cell).agg((F.avg(F.when(near, F.col("v"))) - F.avg("v")).alias("dprime"))


def draw_limits(rate: Column, most: int = 7) -> Column:
    """The least hashes, as twelve hexadecimal digits, at which a Poisson number of the rate is 1, 2, ... up to ``most``; 'g', above all, where there is none."""
    chance, upto, limits = F.exp(-rate), F.exp(-rate), []
    for k in range(1, most + 1):
        least = F.ceil(upto * float(16**12)).cast("long")
        limits.append(F.when(least < 16**12, F.lower(F.lpad(F.hex(least), 12, "0"))).otherwise("g"))
        chance = chance * rate / k
        upto = upto + chance
    return F.array(*limits)


def drawn_times(share: Column, limits: Column, most: int = 7) -> Column:
    """How often a round draws a row: a Poisson number, from the hash of both and the rate's limits, which are in rising order."""
    times = F.lit(most)
    for k in reversed(range(most)):
        times = F.when(share < F.get(limits, F.lit(k)), k).otherwise(times)
    return times


def resampled_selectivity(grid: DataFrame, cell: list[str], value: str = "sig_pk", rounds: int = 100) -> DataFrame:
    """(cell, rounds, dprime, se, low, high): ``selectivity`` against ``rounds`` random draws of as many responses as the peak has neighbours.

    A round draws each point of a cell's grid a Poisson number of times, told by the
    hash of its place and the round, so that no round needs the others' draws or a
    size to be kept, and a rerun draws the same. Points without a response are drawn,
    too, and count for nothing; rounds that draw no response are left out. low and high
    hold 95 % of the rounds.
    """
    own = Window.partitionBy(*cell)
    axes = grid.select(*cell, "db", "freq", F.col(value).alias("v"), F.dense_rank().over(own.orderBy("db")).alias("i"), F.dense_rank().over(own.orderBy("freq")).alias("j"), F.count("*").over(own).alias("n"))
    peak = F.max(F.when(F.col("v").isNotNull(), F.struct("v", (-F.col("j")).alias("j"), (-F.col("i")).alias("i")))).over(own)
    near = F.coalesce(F.abs(F.col("i") + F.col("top.i")) + F.abs(F.col("j") + F.col("top.j")) <= 1, F.lit(False))
    marked = axes.withColumn("top", peak).withColumn("near", near)
    sized = marked.withColumns({"around": F.avg(F.when(F.col("near"), F.col("v"))).over(own), "rate": F.sum(F.col("near").cast("double")).over(own) / F.col("n")})
    place = F.concat_ws(":", *[F.col(c).cast("string") for c in (*cell, "i", "j")], F.lit(""))
    points = sized.where(F.col("v").isNotNull()).select(*cell, "v", "around", place.alias("place"), draw_limits(F.col("rate")).alias("limits"))  # once a point
    rows = points.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    hashed = rows.withColumn("share", F.substring(F.md5(F.concat("place", F.col("round").cast("string"))), 1, 12))
    draws = hashed.withColumn("times", drawn_times(F.col("share"), F.col("limits")))
    each = draws.groupBy(*cell, "round").agg((F.max("around") - F.try_divide(F.sum(F.col("times") * F.col("v")), F.sum("times"))).alias("d")).where("d IS NOT NULL")
    at = lambda q: F.percentile("d", q)  # noqa: E731  a cell has ``rounds`` values
    return each.groupBy(*cell).agg(F.count("*").alias("rounds"), F.avg("d").alias("dprime"), F.stddev_samp("d").alias("se"), at(0.025).alias("low"), at(0.975).alias("high"))


def tuning_curve(grid: DataFrame, cell: list[str], value: str = "sig_pk") -> DataFrame:
    """(freq, mean over levels of the mean over cells)."""
    pairs = grid.groupBy("db", "freq").agg(F.avg(value).alias("r"))
    return pairs.groupBy("freq").agg(F.avg("r").alias("r"))


def three_levels(grid: DataFrame, cell: list[str], keep: tuple[int, ...] = (30, 50, 70)) -> DataFrame:
    """Grids of more than three levels cut to ``keep``; others as they are."""
    sizes = grid.groupBy(*cell).agg(F.count_distinct("db").alias("levels"))
    return grid.join(sizes, cell).where((F.col("levels") <= 3) | F.col("db").isin(*keep)).drop("levels")


def level_functions(trials: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, db, pk, sig) on one level axis, that of all cells; levels that a cell lacks have NULL and false."""
    seen = trials.groupBy(*cell, "db").agg(F.avg("pk").alias("pk"), F.bool_or("sig").alias("sig"))
    axis = seen.agg(F.array_sort(F.collect_set("db")).alias("dbs"))  # one row: the levels played
    cells = seen.select(*cell).distinct().join(F.broadcast(axis)).select(*cell, F.explode("dbs").alias("db"))
    return cells.join(seen, [*cell, "db"], "left").withColumn("sig", F.coalesce("sig", F.lit(False)))


def responsive_cells(curves: DataFrame, cell: list[str], run: int = 3) -> DataFrame:
    """(cell, included, threshold, n_sig): ``run`` significant levels in a row; the threshold is the lowest significant one.

    Gaps and islands: within a cell, the difference of two row numbers is constant
    over a run.
    """
    own = Window.partitionBy(*cell).orderBy("db")
    island = F.row_number().over(own) - F.row_number().over(Window.partitionBy(*cell, "sig").orderBy("db"))
    runs = curves.withColumn("island", island).groupBy(*cell, "sig", "island").agg(F.count("*").alias("n"), F.min("db").alias("low"))
    found = runs.groupBy(*cell).agg(F.coalesce(F.max(F.when(F.col("sig"), F.col("n"))), F.lit(0)).alias("longest"), F.min(F.when(F.col("sig"), F.col("low"))).alias("low"), F.coalesce(F.sum(F.when(F.col("sig"), F.col("n"))), F.lit(0)).alias("n_sig"))
    included = F.col("longest") >= run
    return found.select(*cell, included.alias("included"), F.when(included, F.col("low")).alias("threshold"), "n_sig")


def cohort_curve(curves: DataFrame, cells: DataFrame, cell: list[str]) -> DataFrame:
    """(db, n, mean, sem) of the included cells."""
    kept = curves.join(cells.where("included").select(*cell), cell, "left_semi")
    return kept.groupBy("db").agg(F.count("pk").alias("n"), F.avg("pk").alias("mean"), sem(F.col("pk")).alias("sem"))


def low_over_high(rows: DataFrame, keys: list[str], level: Column, low: int, high: int, value: Column) -> DataFrame:
    """(keys, lo, hi, ratio): mean response at two levels, matched by key."""
    both = rows.groupBy(*keys).agg(F.avg(F.when(level == low, value)).alias("lo"), F.avg(F.when(level == high, value)).alias("hi"))
    return both.withColumn("ratio", F.try_divide("lo", "hi"))
