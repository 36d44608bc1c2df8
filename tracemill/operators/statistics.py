"""Hypothesis tests: statistics as aggregates of the data, p-values from closed forms of the few numbers left."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.distributions import normal_cdf, normal_two_sided, t_quantile, t_two_sided
from tracemill.shipping import ship


def one_sample_t(rows: DataFrame, keys: list[str], x: Column, against: float = 0.0) -> DataFrame:
    """(keys, n, t, df); of paired differences it is the paired test."""
    found = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    return found.select(*keys, "n", F.try_divide(F.col("m") - against, F.col("s") / F.sqrt("n")).alias("t"), (F.col("n") - 1).alias("df"))


def two_sample_t(rows: DataFrame, keys: list[str], x: Column, first: Column) -> DataFrame:
    """(keys, n1, n2, t, df) with pooled variance; ``first`` is true for the first sample."""
    one, two = F.when(first, x), F.when(~first, x)
    found = rows.groupBy(*keys).agg(F.count(one).alias("n1"), F.count(two).alias("n2"), (F.avg(one) - F.avg(two)).alias("d"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"))
    df = F.col("n1") + F.col("n2") - 2
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), df)
    return found.select(*keys, "n1", "n2", F.try_divide(F.col("d"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"), df.alias("df"))


def running_counts(counted: DataFrame, keys: list[str], x: str, ties: str, pieces: int = 64) -> DataFrame:
    """``counted`` (distinct values of each key with their number) with upto, the number of values up to each in its key.

    A key's values are cut at sketched quantiles into pieces; only inside of a piece
    are they put in order, and what all pieces before hold is added. The result does
    not depend on where the cuts lie.
    """
    at = F.array(*[F.lit(k / pieces) for k in range(1, pieces)])
    cuts = counted.groupBy(*keys).agg(F.percentile_approx(F.col(x).cast("double"), at, F.lit(1000)).alias("_cuts"))
    cut = counted.join(cuts, keys).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts")
    sums = cut.groupBy(*keys, "_piece").agg(F.sum(ties).alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(ties).over(Window.partitionBy(*keys, "_piece").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("upto", within).join(sums.select(*keys, "_piece", before.alias("_before")), [*keys, "_piece"]).withColumn("upto", F.col("upto") + F.col("_before")).drop("_piece", "_before")


def quantiles(rows: DataFrame, keys: list[str], x: str, at: dict[str, float]) -> DataFrame:
    """(keys, n, one column for each share): exact quantiles, linear between the two nearest values."""
    counted = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("ties"))
    ranked = running_counts(counted, keys, x, "ties").join(counted.groupBy(*keys).agg(F.sum("ties").alias("n")), keys)
    low = lambda q: F.floor(F.lit(q) * (F.col("n") - 1))  # noqa: E731  positions from 0
    value = lambda k: F.min(F.when(F.col("upto") > k, F.col(x)))
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[f for name, q in at.items() for f in (value(low(q)).alias(f"_{name}"), value(F.least(low(q) + 1, F.col("n") - 1)).alias(f"_{name}_next"))])
    between = lambda name, q: F.col(f"_{name}") + (F.lit(q) * (F.col("n") - 1) - low(q)) * (F.col(f"_{name}_next") - F.col(f"_{name}"))
    return found.select(*keys, "n", *[between(name, q).alias(name) for name, q in at.items()])


def rank_sum(rows: DataFrame, keys: list[str], x: str, first: Column) -> DataFrame:
    """(keys, n1, n2, w, z): rank sum of the first sample, and its normal deviate with the tie correction."""
    marked = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count_if(first).alias("k1"), F.count("*").alias("ties"))
    ranked = running_counts(marked, keys, x, "ties").withColumn("rank", F.col("upto") - (F.col("ties") - 1) / 2)
    t = F.col("ties").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("k1").alias("n1"), (F.sum("ties") - F.sum("k1")).alias("n2"), F.sum(F.col("k1") * F.col("rank")).alias("w"), F.sum(t * t * t - t).alias("tied"))
    n = (F.col("n1") + F.col("n2")).cast("double")
    variance = F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.try_divide(F.col("tied"), n * (n - 1)))
    off = F.col("w") - F.col("n1") * (n + 1) / 2
    z = F.try_divide(off - F.signum(off) * 0.5, F.sqrt(variance))
    return sums.select(*keys, "n1", "n2", "w", z.alias("z"))


def signed_rank(rows: DataFrame, keys: list[str], d: str) -> DataFrame:
    """(keys, n, w, z): sum of the ranks of positive differences; zeros are left out."""
    size = rows.where(F.coalesce(F.col(d) != 0, F.lit(False))).withColumn("_size", F.abs(d))
    counted = size.groupBy(*keys, "_size").agg(F.count_if(F.col(d) > 0).alias("up"), F.count("*").alias("ties"))
    ranked = running_counts(counted, keys, "_size", "ties").withColumn("rank", F.col("upto") - (F.col("ties") - 1) / 2)
    t = F.col("ties").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("ties").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w"), F.sum(t * t * t - t).alias("tied"))
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tied") / 48.0
    off = F.col("w") - n * (n + 1) / 4
    return sums.select(*keys, "n", "w", F.try_divide(off - F.signum(off) * 0.5, F.sqrt(variance)).alias("z"))


def anderson_darling(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, n, a2): Anderson-Darling distance to a normal of the sample's mean and deviation.

    Equal values are one row with their count. The sum pairs value i with value
    n + 1 - i, which splits into two sums over the same order, so no self-join is
    needed; over values that tie, from rank a + 1 to b, the odd numbers add up to
    b squared less a squared.
    """
    counted = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("ties"))
    whole = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    z = running_counts(counted, keys, x, "ties").join(whole, keys).withColumn("_z", F.try_divide(F.col(x) - F.col("_m"), F.col("_s")))
    p = F.greatest(F.least(normal_cdf(F.col("_z")), F.lit(1 - 1e-15)), F.lit(1e-300))
    b, n = F.col("upto").cast("double"), F.col("n").cast("double")
    a = b - F.col("ties")
    term = (b * b - a * a) * F.log("_p") + ((n - a) * (n - a) - (n - b) * (n - b)) * F.log1p(-F.col("_p"))
    return z.withColumn("_p", p).groupBy(*keys).agg(F.max("n").alias("n"), (-F.max("n") - F.sum(term) / F.max("n")).alias("a2"))


#: Fixed value: the normal quantile of 97.5 %.
Z95 = 1.959963984540054


def least_squares(rows: DataFrame, keys: list[str], x: Column, y: Column, log_scale: bool = False) -> DataFrame:
    """(keys, n, slope, intercept, slope_se, slope0, and what a band needs): the line, its slope's standard error, and the slope through the origin; ``log_scale`` takes log10 of both, of positive pairs."""
    if log_scale:
        x, y = (F.when((x > 0) & (y > 0), F.log10(v)) for v in (x, y))
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1.0))
    a, b = x * both, y * both
    found = rows.groupBy(*keys).agg(F.count(both).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.sum(a * a).alias("xx"), F.sum(b * b).alias("yy"), F.try_divide(F.sum(a * b), F.sum(a * a)).alias("slope0"), F.avg(a).alias("x_mean"), F.min(a).alias("x_low"), F.max(a).alias("x_high"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    rest0 = F.greatest(F.col("yy") - F.col("slope0") * F.col("slope0") * F.col("xx"), F.lit(0.0))
    residual, residual0 = F.sqrt(F.try_divide(rest, F.col("n") - 2)), F.sqrt(F.try_divide(rest0, F.col("n") - 1))
    return found.select(*keys, "n", "slope", "intercept", F.try_divide(residual, F.sqrt("sxx")).alias("slope_se"), "slope0", residual.alias("residual"), residual0.alias("residual0"), "sxx", "xx", "x_mean", "x_low", "x_high")


def with_t_quantile(rows: DataFrame, df: Column, level: float = 0.95, z: float = Z95) -> DataFrame:
    """Rows with the column t_quantile, worked out once for each number of degrees of freedom."""
    marked = rows.withColumn("_df", df)
    known = marked.select("_df").distinct().withColumn("t_quantile", t_quantile(level, F.col("_df"), z))
    return marked.join(known, "_df", "left").drop("_df")


def slope_interval(fit: DataFrame, against: float = 1.0) -> DataFrame:
    """A line of ``least_squares`` with its slope's 95 % confidence interval, and whether that includes ``against``."""
    wide = F.col("t_quantile") * F.col("slope_se")
    low, high = F.col("slope") - wide, F.col("slope") + wide
    return with_t_quantile(fit, F.col("n") - 2).withColumns({"slope_low": low, "slope_high": high, "includes": F.lit(against).between(low, high)}).drop("t_quantile")


def line_band(fit: DataFrame, keys: list[str], points: int = 1000, intercept: bool = True) -> DataFrame:
    """(keys, point, x, y, low, high): the line of ``least_squares`` from its least x, or from 0 without an intercept or where x begins below, to its largest, with the 95 % band of its mean."""
    lines = with_t_quantile(fit, F.col("n") - (2 if intercept else 1))
    start = F.when(F.col("x_low") > 0, F.col("x_low")).otherwise(0.0) if intercept else F.lit(0.0)
    at = lines.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", start + (F.col("x_high") - start) * F.col("point") / (points - 1))
    off = F.col("x") - F.col("x_mean")
    if intercept:
        y, se = F.col("intercept") + F.col("slope") * F.col("x"), F.col("residual") * F.sqrt(1 / F.col("n") + F.try_divide(off * off, F.col("sxx")))
    else:
        y, se = F.col("slope0") * F.col("x"), F.try_divide(F.col("residual0") * F.abs("x"), F.sqrt("xx"))
    return at.select(*keys, "point", "x", y.alias("y"), (y - F.col("t_quantile") * se).alias("low"), (y + F.col("t_quantile") * se).alias("high"))


def paired_effects(rows: DataFrame, keys: list[str], contrasts: dict[str, Column]) -> DataFrame:
    """(keys, effect, n, f, df): within-subject effects of one degree of freedom, F = t squared of each subject's contrast score."""
    scores = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("effect"), v.alias("score")) for k, v in contrasts.items()])).alias("x")).select(*keys, "x.effect", "x.score")
    tested = one_sample_t(scores, [*keys, "effect"], F.col("score"))
    return tested.select(*keys, "effect", "n", (F.col("t") * F.col("t")).alias("f"), "df")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def bonferroni(p: Column, comparisons: int) -> Column:
    return F.least(p * comparisons, F.lit(1.0))


def drawn_by(row: Column, draw: Column) -> Column:
    """60 bits of a row's and a round's hash, in hexadecimal; the order by it is the order in which a round draws."""
    return F.substring(F.md5(F.concat(row.cast("string"), F.lit(":"), draw.cast("string"))), 1, 15)


def near_limits(n: Column, n1: Column, log_odds: float = 20.0) -> tuple[Column, Column]:
    """Hashes, in hexadecimal, between which the ``n1``-th of ``n`` random ones lies but for a chance of about exp(-log_odds) (Bernstein); "" and "~" stand below and above all."""
    margin = log_odds + F.sqrt(2 * log_odds * n1 * (1 - n1 / n))
    text = lambda at: F.lower(F.lpad(F.hex((at * float(1 << 60)).cast("long")), 15, "0"))
    low, high = (n1 - margin) / n, (n1 + margin) / n
    return F.when(low > 0, text(low)).otherwise(""), F.when(high < 1, text(high)).otherwise("~")


def permutation_test(rows: DataFrame, keys: list[str], x: str, first: Column, row: str, rounds: int = 1000, block: int = 20) -> DataFrame:
    """(keys, n, difference, p): difference of means against ``rounds`` reshuffles of the labels, which keep both samples' sizes.

    A round's first sample are the rows of least hash of ``row`` (a key of the row,
    so the result does not depend on how rows are dealt; rows that share it are taken
    in the order of ``x``) and round. Each draw is hashed once. Those of hashes far below or
    above the one at which the sample's size is to be expected are summed before the
    exchange, those near it are exchanged and put in order. Rounds of which the size is
    reached elsewhere (rows that share their hashes) are drawn again in full, ``block``
    of a key's at a time. No join sends rows or draws through the driver: Parquet's
    sizes and rows that become many mislead the choice of what to broadcast.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism  # a row becomes one for each round, so that few bytes are much work
    marked = rows.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"), first.alias("_first"), F.col(row).alias("_row"))
    group = marked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_first").alias("n1"), F.sum("_x").alias("total"), F.sum(F.when(F.col("_first"), F.col("_x"))).alias("sum1"))
    group = group.where("n1 > 0 AND n1 < n").hint("merge")
    mean = lambda s: F.col(s) / F.col("n1") - (F.col("total") - F.col(s)) / (F.col("n") - F.col("n1"))
    hashed = lambda df: df.withColumn("_hash", F.coalesce(drawn_by(F.col("_row"), F.col("round")), F.lit("g")))  # noqa: E731  rows without a key come last
    low, high = near_limits(F.col("n"), F.col("n1"))
    dealt = marked.join(group.select(*keys, "n1", low.alias("_low"), high.alias("_high")), keys).select(*keys, "n1", "_x", "_row", "_low", "_high").repartition(tasks)
    spread = hashed(dealt.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))))
    spread = spread.withColumn("_side", F.when(F.col("_hash") < F.col("_low"), 0).when(F.col("_hash") < F.col("_high"), 1).otherwise(2))
    near = [F.when(F.col("_side") == 1, F.col(c)).alias(c) for c in ("_hash", "_row", "_x")]
    sums = spread.groupBy(*keys, "n1", "round", "_side", *near).agg(F.count("*").alias("k"), F.sum("_x").alias("s"))
    upto = Window.partitionBy(*keys, "n1", "round").orderBy("_side", "_hash", "_row", "_x").rowsBetween(Window.unboundedPreceding, 0)
    taken = sums.withColumn("_take", F.least("k", F.greatest(F.lit(0), F.col("n1") - F.sum("k").over(upto) + F.col("k"))))
    amount = F.when(F.col("_take") == F.col("k"), F.col("s")).when(F.col("_take") > 0, F.col("_take") * F.col("_x"))
    cut = (F.col("_side") != 1) & (F.col("_take") > 0) & (F.col("_take") < F.col("k"))
    draws = taken.groupBy(*keys, "n1", "round").agg(F.when(~F.bool_or(cut), F.sum(amount)).alias("drawn"))
    missed = draws.where("drawn IS NULL").groupBy(*keys, "n1", F.floor(F.col("round") / block).alias("_block")).agg(F.collect_list("round").alias("_rounds"))  # at most ``block`` of them
    again = marked.join(missed.hint("merge"), keys).select(*keys, "n1", "_x", "_row", "_rounds").repartition(tasks)
    again = hashed(again.select(*keys, "n1", "_x", "_row", F.explode("_rounds").alias("round")))
    again = again.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "round").orderBy("_hash", "_row", "_x"))).where("_at <= n1")
    again = again.groupBy(*keys, "round").agg(F.sum("_x").alias("drawn"))
    both = draws.where("drawn IS NOT NULL").select(*keys, "round", "drawn").unionByName(again).join(group, keys)
    extreme = F.count_if(F.abs(mean("drawn")) >= F.abs(mean("sum1")) - 1e-9)
    return both.groupBy(*keys).agg(F.max("n").alias("n"), F.max(mean("sum1")).alias("difference"), ((extreme + 1) / (F.count("*") + 1)).alias("p"))


def exact_permutation_test(rows: DataFrame, keys: list[str], x: str, first: Column, most: int = 16, unit: float | None = None) -> DataFrame:
    """(keys, n, difference, p) over all ways to draw the first sample, for keys of at most ``most`` values; larger ones are left to ``permutation_test``.

    Values that are whole multiples of ``unit`` are added up in whole numbers, so that
    equal differences tie exactly. Others are added in rising order, the given sample
    like the drawn ones, and tie within 1e-9. Sums of a key's subsets are made from
    those without its last value, in one row; no subset is a row of its own.
    """
    value = F.round(F.col(x) / unit).cast("long") if unit else F.col(x).cast("double")
    zero = F.lit(0).cast("long") if unit else F.lit(0.0)
    sizes = rows.groupBy(*keys).agg(F.count(x).alias("n")).where(F.col("n") <= most)
    lists = rows.where(F.col(x).isNotNull()).join(sizes, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.count_if(first).alias("n1"), F.sort_array(F.collect_list(F.struct(value.alias("v"), F.coalesce(first, F.lit(False)).alias("f")))).alias("_xs")).where("n1 > 0 AND n1 < n")
    start = F.array(F.struct(F.lit(0).alias("k"), zero.alias("s")))
    more = lambda acc, one: F.concat(acc, F.transform(F.filter(acc, lambda a: a["k"] < F.col("n1")), lambda a: F.struct((a["k"] + 1).alias("k"), (a["s"] + one["v"]).alias("s"))))
    drawn = F.transform(F.filter(F.aggregate("_xs", start, more), lambda a: a["k"] == F.col("n1")), lambda a: a["s"])
    own = F.aggregate("_xs", zero, lambda acc, one: acc + F.when(one["f"], one["v"]).otherwise(zero))
    every = F.aggregate("_xs", zero, lambda acc, one: acc + one["v"])
    sums = lists.select(*keys, "n", "n1", drawn.alias("_drawn"), own.alias("_s"), every.alias("_t"))
    if unit:
        gap = lambda s: s * F.col("n") - F.col("_t") * F.col("n1")
        difference, slack = gap(F.col("_s")) / (F.col("n1") * (F.col("n") - F.col("n1"))) * unit, 0
    else:
        gap = lambda s: s / F.col("n1") - (F.col("_t") - s) / (F.col("n") - F.col("n1"))
        difference, slack = gap(F.col("_s")), 1e-9
    given = sums.withColumn("_given", F.abs(gap(F.col("_s"))) - slack)
    return given.select(*keys, "n", difference.alias("difference"), (F.size(F.filter("_drawn", lambda s: F.abs(gap(s)) >= F.col("_given"))) / F.size("_drawn")).alias("p"))


def sum_distribution(scores: np.ndarray, size: int) -> np.ndarray:
    """The chances of the sums of ``size`` of the whole numbers ``scores`` (from 0), all choices alike: item by item, shifted by the item's score where it is taken."""
    most = int(np.sort(scores)[len(scores) - size :].sum())
    chance = np.zeros((size + 1, most + 1))
    chance[0, 0] = 1.0
    n = len(scores)
    for i, x in enumerate(np.sort(scores).tolist()):  # in rising order, so that few of the sums are reached at first
        rows, width = min(i + 1, size) + 1, min(most, size * x) + 1
        take = np.clip((size - np.arange(rows)) / (n - i), 0.0, 1.0)[:, None]
        taken = chance[: rows - 1, : width - x] * take[:-1]
        chance[:rows, :width] *= 1.0 - take
        chance[1:rows, x:width] += taken
    return chance[size]


def window_of(spread: int, size: int) -> float:
    """Sums of ``size`` numbers, drawn without putting back from a range of ``spread``, lie this near to their mean but for 1e-14 (Hoeffding)."""
    return spread * math.sqrt(17.0 * size)


def transformed_distribution(scores: np.ndarray, times: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """What ``sum_distribution`` gives, with its first sum: the chances in the window of sums that are reached but for 1e-13, from their Fourier transform.

    Draws of each item for itself, with a chance of size / n, are independent, so the
    transform is a product over the distinct scores; draws of ``size`` items are told
    apart by a second transform, over the number drawn. Frequencies at which the first
    one is bound to be below 1e-14 in all, by that of the scores, are left out.
    """
    n, most = int(times.sum()), int(scores.max())
    p = size / n
    var = n * p * (1 - p)
    reach = math.ceil(window_of(most, size))
    start, cells = max(0, round(p * float((scores * times).sum())) - reach), 2 * reach + 1
    if size * most + 1 <= cells:
        start, cells = 0, size * most + 1
    hit = math.exp(math.lgamma(n + 1) - math.lgamma(size + 1) - math.lgamma(n - size + 1) + size * math.log(p) + (n - size) * math.log1p(-p))  # the chance to draw ``size``
    log = math.log(2e16 / hit)
    sizes = min(n + 1, math.ceil(log / 3 + math.sqrt(log * log / 9 + 2 * log * var)) + 1)  # by Bernstein, others than ``size`` that fall together with it are as rare
    shape = np.abs(np.fft.rfft(np.bincount(scores % cells, weights=times, minlength=cells)))
    kept = np.flatnonzero(-p * (1 - p) * (n - shape) - math.log(hit) > math.log(1e-14 / cells))
    angle = 2 * np.pi / sizes * np.arange(sizes)
    found = np.zeros(len(shape), complex)
    step = max(1, (1 << 19) // len(scores))
    for t in kept.tolist():
        turn = 2 * np.pi * ((t * scores) % cells) / cells
        total = 0j
        for at in range(0, sizes, step):
            some = angle[at : at + step]
            total += np.exp(np.log1p(p * np.expm1(1j * (some[:, None] + turn))) @ times - 1j * ((size * np.arange(at, at + len(some))) % sizes) * (2 * np.pi / sizes)).sum()
        found[t] = (total / sizes / hit).conjugate()
    chance = np.fft.irfft(found / found[0].real, cells)  # all chances together are 1
    return np.clip(np.roll(chance, -(start % cells)), 0.0, None), start


def counted_permutation_test(rows: DataFrame, keys: list[str], x: str, first: Column, unit: float, row: str, cells: int = 1 << 24, rounds: int = 1000) -> DataFrame:
    """(keys, n, difference, p) over all ways to draw the first sample, of values in whole units.

    Subsets are not drawn but counted by their sum, so that p is exact (to 1e-12)
    whatever the sample's size: in a table with a cell for each size and sum, or by the
    transform of the sums, whichever is less work. Keys of which both the table and, or
    for samples below 64, the transform would pass ``cells`` are tested by
    ``permutation_test`` with ``rounds`` draws.
    """
    scored = rows.where(F.col(x).isNotNull()).select(*keys, F.floor(F.col(x) / unit).cast("long").alias("_x"), first.alias("_first"), F.col(row).alias("_row"))
    totals = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_first").alias("n1"), F.sum("_x").alias("t"), F.sum(F.when(F.col("_first"), F.col("_x"))).alias("s"), F.min("_x").alias("low"), F.max("_x").alias("high")).where("n1 > 0 AND n1 < n")
    small = F.least("n1", F.col("n") - F.col("n1"))
    spread = F.col("high") - F.col("low")
    sizes = totals.withColumn("_exact", ((small + 1) * (small * spread + 1) <= cells) | ((small >= 64) & (2 * spread * F.sqrt(17.0 * small) + 3 <= cells)))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def counted(group: pa.Table) -> pa.Table:
        one = {c: group.column(c)[0].as_py() for c in ("n", "n1", "t", "s", "low")}
        n, n1, low = one["n"], one["n1"], one["low"]
        values, times = group.column("_x").to_numpy() - low, group.column("_times").to_numpy()
        k = min(n1, n - n1)
        table = n * (k + 1) * (k * int(values.max()) + 1)
        if k < 64 or table < 1 << 24:
            chance, start = sum_distribution(np.repeat(values, times), k), 0
        else:
            chance, start = transformed_distribution(values, times, k)
        drawn = np.arange(start, start + len(chance)) + k * low  # the sum of the smaller sample
        mean = lambda s, m: s / m - (one["t"] - s) / (n - m)
        given = mean(one["s"], n1)
        extreme = np.abs(mean(drawn, k)) >= abs(given) - 1e-9
        return pa.table([group.column(c).slice(0, 1) for c in keys] + [pa.array([n]), pa.array([given * unit]), pa.array([min(1.0, float(chance[extreme].sum()))])], names=[*keys, "n", "difference", "p"])

    ship(rows.sparkSession)
    times = scored.groupBy(*keys, "_x").agg(F.count("*").alias("_times"))
    exact = times.join(sizes.where("_exact"), keys).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys).groupBy(*keys).applyInArrow(counted, f"{kinds}, n long, difference double, p double")  # a row for each unit
    if not sizes.where("NOT _exact").limit(1).count():
        return exact
    large = scored.join(sizes.where("NOT _exact").select(*keys), keys, "left_semi").withColumn("_x", F.col("_x") * unit)
    return exact.unionByName(permutation_test(large, keys, "_x", F.col("_first"), "_row", rounds))


#: The 5 % point of the adjusted Anderson-Darling statistic.
NORMAL_LIMIT = 0.752


def looks_normal(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, normal): the adjusted Anderson-Darling distance is below its 5 % point."""
    adjusted = F.col("a2") * (1 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n")))
    return anderson_darling(rows, keys, x).select(*keys, F.coalesce(adjusted < NORMAL_LIMIT, F.lit(False)).alias("normal"))


def judged(both: DataFrame, keys: list[str], names: tuple[str, str], alpha: float) -> DataFrame:
    pick = lambda c: F.when(F.col("normal"), F.col(f"{c}_t")).otherwise(F.col(f"{c}_w"))
    p = pick("p")
    return both.select(*keys, "normal", F.when(F.col("normal"), names[0]).otherwise(names[1]).alias("test"), pick("stat").alias("stat"), p.alias("p"), F.coalesce(p < alpha, F.lit(False)).alias("sig"))


def significant_difference(rows: DataFrame, keys: list[str], x: str, first: Column, alpha: float = 0.05) -> DataFrame:
    """(keys, normal, test, stat, p, sig): t test where the pooled values look normal, else the rank-sum test."""
    t = two_sample_t(rows, keys, F.col(x), first).select(*keys, F.col("t").alias("stat_t"), t_two_sided(F.col("t"), F.col("df")).alias("p_t"))
    w = rank_sum(rows, keys, x, first).select(*keys, F.col("z").alias("stat_w"), normal_two_sided(F.col("z")).alias("p_w"))
    return judged(looks_normal(rows, keys, x).join(t, keys).join(w, keys), keys, ("t", "rank sum"), alpha)


def significant_shift(rows: DataFrame, keys: list[str], x: str, against: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """(keys, normal, test, stat, p, sig) of one sample against a number; of paired differences it is the paired test."""
    moved = rows.withColumn(x, F.col(x) - against)
    t = one_sample_t(moved, keys, F.col(x)).select(*keys, F.col("t").alias("stat_t"), t_two_sided(F.col("t"), F.col("df")).alias("p_t"))
    w = signed_rank(moved, keys, x).select(*keys, F.col("z").alias("stat_w"), normal_two_sided(F.col("z")).alias("p_w"))
    return judged(looks_normal(moved, keys, x).join(t, keys).join(w, keys, "left"), keys, ("t", "signed rank"), alpha)
