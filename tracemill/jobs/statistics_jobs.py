"""Cohort statistics over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.distributions import ERFC
from tracemill.jobs.registry import query, r6, rounded, table
from tracemill.operators import statistics as st


@query("SELECT o_orderpriority AS grp, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 4) + 0.0 AS q1, round(quantile_cont(o_totalprice, 0.5), 4) + 0.0 AS median, round(quantile_cont(o_totalprice, 0.75), 4) + 0.0 AS q3, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-number summaries."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("x"))
    ends = rows.groupBy("grp").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return rounded(st.quantiles(rows, ["grp"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}), "q1", "median", "q3", digits=4).join(ends, "grp")


@query("WITH d AS (SELECT round(abs(log2((o_totalprice + 1) / (o_custkey + 1))), 9) AS shift FROM orders) SELECT floor(shift / 0.25)::BIGINT AS bin, count(*) AS n FROM d GROUP BY 1")
def hist_bf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of shifts in octaves, a quarter octave wide; shifts are rounded to nine digits first, so that those at a bin's edge belong to the bin above it."""
    shift = F.round(F.abs(F.log2((F.col("o_totalprice") + 1) / (F.col("o_custkey") + 1))), 9)
    rows = table(spark, sf_dir, "orders").select(shift.alias("shift"))
    return rows.groupBy(F.floor(F.col("shift") / 0.25).alias("bin")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT o_orderpriority AS grp, count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus <> 'F') AS n2, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus <> 'F') AS d, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v1, var_samp(o_totalprice) FILTER (o_orderstatus <> 'F') AS v2 FROM orders GROUP BY 1)
SELECT grp, n1, n2, round(d / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) + 0.0 AS t, n1 + n2 - 2 AS df FROM s"""
)
def ttest_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sample t statistics with pooled variance."""
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "grp")
    return rounded(st.two_sample_t(rows, ["grp"], F.col("o_totalprice"), F.col("o_orderstatus") == "F"), "t")


@query(
    """WITH r AS (SELECT o_orderpriority AS grp, o_orderstatus = 'F' AS a, rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, floor(o_totalprice / 1000)) - 1) / 2.0 AS k FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 1000)))
SELECT grp, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2, sum(k) FILTER (a)::DOUBLE AS w FROM r GROUP BY 1"""
)
def ranksum_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank sums with mid-ranks for ties."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.floor(F.col("o_totalprice") / 1000).alias("x"), "o_orderstatus")
    return st.rank_sum(rows, ["grp"], "x", F.col("o_orderstatus") == "F").select("grp", "n1", "n2", F.col("w").cast("double").alias("w"))


@query(
    """WITH d AS (SELECT l_shipdate::DATE AS day, l_returnflag AS grp, floor(l_quantity - 25) AS d FROM lineitem), n AS (SELECT grp, d, abs(d) AS size FROM d WHERE d <> 0),
r AS (SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY size) + (count(*) OVER (PARTITION BY grp, size) - 1) / 2.0 AS k FROM n) SELECT grp, count(*) AS n, coalesce(sum(k) FILTER (d > 0), 0)::DOUBLE AS w FROM r GROUP BY 1"""
)
def signrank_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank sums of differences."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.floor(F.col("l_quantity") - 25).alias("d"))
    return st.signed_rank(rows, ["grp"], "d").select("grp", "n", F.col("w").cast("double").alias("w"))


@query(
    """WITH s AS (SELECT l_returnflag AS grp, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS slope0 FROM lineitem GROUP BY 1)
SELECT grp, n, round(slope, 4) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept, round(sqrt((syy - slope * slope * sxx) / (n - 2) / sxx), 4) + 0.0 AS slope_se, round(slope0, 4) + 0.0 AS slope0 FROM s"""
)
def ols_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares lines, their slopes' standard errors and slopes through the origin."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "grp")
    return rounded(st.least_squares(rows, ["grp"], F.col("l_quantity"), F.col("l_extendedprice")).select("grp", "n", "slope", "intercept", "slope_se", "slope0"), "slope", "intercept", "slope_se", "slope0", digits=4)


@query(
    "WITH m AS (SELECT l_suppkey AS cell, avg(l_extendedprice) FILTER (l_linenumber <= 3) - avg(l_extendedprice) FILTER (l_linenumber > 3) AS d FROM lineitem GROUP BY 1) SELECT count(d) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) + 0.0 AS t, count(d) - 1 AS df FROM m"
)
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired t statistic over cells, low against high levels."""
    low = F.col("l_linenumber") <= 3
    d = F.avg(F.when(low, F.col("l_extendedprice"))) - F.avg(F.when(~low, F.col("l_extendedprice")))
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(d.alias("d"))
    return rounded(st.one_sample_t(pairs, [], F.col("d")), "t")


def tail_sql(z: str) -> str:
    """The share of a normal distribution beyond |z| on one side, by the rational approximation."""
    t = f"(1 / (1 + abs({z}) / sqrt(2) / 2))"
    power = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = f"({c} + {t} * {power})"
    return f"({t} * exp({power} - ({z}) * ({z}) / 2) / 2)"


def inside_sql(angle: str, df: str) -> str:
    """P(|T| < t) at the angle atan(t / sqrt(df)): sums over even or odd powers, their products as gamma functions."""
    even = f"sin({angle}) * list_sum([exp(2 * k * ln(cos({angle})) + lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) FOR k IN range(0, {df} // 2)])"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum([exp((2 * k + 1) * ln(cos({angle})) + lgamma(k + 1) - lgamma(k + 1.5) + lgamma(1.5)) FOR k IN range(0, ({df} - 1) // 2)]), 0))"
    return f"CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


def two_sided_sql(t: str, df: str) -> str:
    normal = tail_sql(f"(abs({t}) * (1 - 1 / (4.0::DOUBLE * {df})) / sqrt(1 + {t} * {t} / (2.0::DOUBLE * {df})))")
    return f"CASE WHEN {df} <= 10000 THEN greatest(1 - ({inside_sql(f'atan(abs({t}) / sqrt({df}))', df)}), 0) ELSE 2 * {normal} END"


def quantile_sql(df: str) -> str:
    """The 97.5 % point of Student's t, by halving the range of the angle fifty times."""
    middle = "((s.low + s.high) / 2)"
    halved = f"list_reduce([{{'low': 0.0::DOUBLE, 'high': pi() / 2}}] || [{{'low': 0.0::DOUBLE, 'high': 0.0::DOUBLE}} FOR j IN range(50)], lambda s, x: CASE WHEN ({inside_sql(middle, df)}) < 0.95 THEN {{'low': {middle}, 'high': s.high}} ELSE {{'low': s.low, 'high': {middle}}} END)"
    return f"(SELECT sqrt({df}) * tan((h.low + h.high) / 2) FROM (SELECT {halved} AS h))"


def darling(values: str) -> str:
    """SQL of Anderson-Darling distances ad(grp, n, a2) of a query's (grp, x); its other tables begin with ad_."""
    return f"""ad_v AS ({values}), ad_z AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY x) AS i, count(*) OVER (PARTITION BY grp) AS n, (x - avg(x) OVER (PARTITION BY grp)) / nullif(stddev_samp(x) OVER (PARTITION BY grp), 0) AS z FROM ad_v WHERE x IS NOT NULL),
ad_p AS (SELECT grp, i, n, greatest(least(CASE WHEN z > 0 THEN 1 - {tail_sql("z")} ELSE {tail_sql("z")} END, 1 - 1e-15), 1e-300) AS p FROM ad_z),
ad AS (SELECT grp, max(n) AS n, -max(n) - sum((2 * i - 1) * ln(p) + (2 * (n - i) + 1) * ln(1 - p)) / max(n) AS a2 FROM ad_p GROUP BY grp)"""


DAYS = darling("SELECT o_orderpriority AS grp, avg(o_totalprice) AS x FROM orders GROUP BY o_orderpriority, o_orderdate")


@query(f"WITH {DAYS} SELECT grp, n, round(a2, 6) + 0.0 AS a2 FROM ad")
def ad_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anderson-Darling distance of daily order values to a normal."""
    days = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderdate").agg(F.avg("o_totalprice").alias("x"))
    return rounded(st.anderson_darling(days.withColumnRenamed("o_orderpriority", "grp"), ["grp"], "x"), "a2")


POOLED = darling("SELECT o_orderpriority AS grp, o_totalprice AS x FROM orders")


@query(
    f"""WITH {POOLED}, s AS (SELECT o_orderpriority AS grp, count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus <> 'F') AS n2, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus <> 'F') AS d, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v1, var_samp(o_totalprice) FILTER (o_orderstatus <> 'F') AS v2 FROM orders GROUP BY 1),
tt AS (SELECT grp, d / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t, n1 + n2 - 2 AS df FROM s),
r AS (SELECT o_orderpriority AS grp, o_orderstatus = 'F' AS a, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) AS ties FROM orders),
w AS (SELECT grp, count(*) FILTER (a)::DOUBLE AS n1, count(*) FILTER (NOT a)::DOUBLE AS n2, count(*)::DOUBLE AS n, sum(k) FILTER (a) AS w, sum(ties * ties - 1)::DOUBLE AS tied FROM r GROUP BY 1),
z AS (SELECT grp, (w - n1 * (n + 1) / 2 - sign(w - n1 * (n + 1) / 2) * 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - tied / (n * (n - 1)))) AS z FROM w),
j AS (SELECT ad.grp, coalesce(a2 * (1 + 0.75 / n + 2.25 / (n * n)) < 0.752, false) AS normal, t, df, zz.z FROM ad JOIN tt USING (grp) JOIN z AS zz USING (grp)),
p AS (SELECT grp, normal, CASE WHEN normal THEN 't' ELSE 'rank sum' END AS test, CASE WHEN normal THEN t ELSE z END AS stat, CASE WHEN normal THEN {two_sided_sql("t", "df")} ELSE 2 * {tail_sql("z")} END AS p FROM j),
c AS (SELECT *, least(p * 5, 1.0) AS own FROM p)
SELECT grp, normal, test, round(stat, 6) + 0.0 AS stat, round(p, 6) + 0.0 AS p, p < 0.05 AS sig, round(own, 6) + 0.0 AS p_corrected, CASE WHEN own < 0.001 THEN '***' WHEN own < 0.01 THEN '**' WHEN own < 0.05 THEN '*' ELSE '' END AS stars FROM c"""
)
def sig_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test fits, its p-value and star label, by priority."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("x"), "o_orderstatus")
    found = st.significant_difference(rows, ["grp"], "x", F.col("o_orderstatus") == "F")
    corrected = st.bonferroni(F.col("p"), 5)
    return found.select("grp", "normal", "test", r6(F.col("stat")).alias("stat"), r6(F.col("p")).alias("p"), "sig", r6(corrected).alias("p_corrected"), st.stars(corrected).alias("stars"))


SAMPLES = "v AS (SELECT c_nationkey AS grp, c_acctbal AS x, false AS first, 'c' || c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, s_acctbal, true, 's' || s_suppkey FROM supplier)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("x"), F.lit(False).alias("first"), F.concat(F.lit("c"), F.col("c_custkey")).alias("id"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("x"), F.lit(True).alias("first"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"))
    return a.union(b)


@query(
    f"""WITH {SAMPLES}, g AS (SELECT grp, count(*) AS n, count(*) FILTER (first) AS n1, sum(x) AS t, sum(x) FILTER (first) AS s FROM v GROUP BY grp HAVING count(*) FILTER (first) BETWEEN 1 AND count(*) - 1),
r AS (SELECT v.grp, k, x, row_number() OVER (PARTITION BY v.grp, k ORDER BY ('0x' || substr(md5(id || ':' || k), 1, 15))::BIGINT, id) AS place FROM v, range(1, 201) q(k)),
d AS (SELECT r.grp, k, sum(x) AS drawn FROM r JOIN g USING (grp) WHERE place <= n1 GROUP BY ALL),
e AS (SELECT d.grp, n, s / n1 - (t - s) / (n - n1) AS difference, drawn / n1 - (t - drawn) / (n - n1) AS d FROM d JOIN g USING (grp))
SELECT grp, max(n) AS n, round(max(difference), 6) + 0.0 AS difference, round((count(*) FILTER (abs(d) >= abs(difference) - 1e-9) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM e GROUP BY grp"""
)
def perm_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation tests of suppliers' balances against customers' by nation; labels are drawn by hash, sizes kept."""
    return rounded(st.permutation_test(samples(spark, sf_dir), ["grp"], "x", F.col("first"), "id", rounds=200), "difference", "p")


@query(
    f"""WITH RECURSIVE {SAMPLES}, b AS (SELECT grp, floor(x / 100)::BIGINT AS x, first FROM v), g AS (SELECT grp, count(*) AS n, count(*) FILTER (first) AS n1, sum(x)::BIGINT AS t, sum(x) FILTER (first)::BIGINT AS s, min(x) AS low FROM b GROUP BY grp HAVING count(*) FILTER (first) BETWEEN 1 AND count(*) - 1),
item AS MATERIALIZED (SELECT b.grp, n, least(n1, n - n1) AS m, b.x - low AS x, row_number() OVER (PARTITION BY b.grp ORDER BY b.x) - 1 AS i FROM b JOIN g USING (grp)),
dp AS (SELECT grp, 0::BIGINT AS i, 0::BIGINT AS k, 0::BIGINT AS s, 1.0::DOUBLE AS p FROM g UNION ALL
  SELECT dp.grp, dp.i + 1, k + take, dp.s + take * x, sum(p * CASE WHEN take = 1 THEN (m - k) / (n - dp.i)::DOUBLE ELSE 1 - (m - k) / (n - dp.i)::DOUBLE END) FROM dp JOIN item ON item.grp = dp.grp AND item.i = dp.i, (VALUES (0), (1)) q(take) WHERE k + take <= m AND m - k - take <= n - dp.i - 1 GROUP BY ALL),
d AS (SELECT g.grp, n, s, p, given, drawn / m - (t - drawn) / (n - m) AS d FROM (SELECT dp.grp, dp.p, dp.s + least(n1, n - n1) * low AS drawn, n, n1, t, least(n1, n - n1) AS m, g.s / n1 - (t - g.s) / (n - n1) AS given, g.s FROM dp JOIN g ON g.grp = dp.grp AND dp.i = g.n) g)
SELECT grp, max(n) AS n, round(max(given) * 100, 6) + 0.0 AS difference, round(least(sum(p) FILTER (abs(d) >= abs(given) - 1e-9), 1), 6) AS p FROM d GROUP BY grp"""
)
def perm_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation tests of suppliers' balances, in hundreds, against customers' by nation: exact, from counts of all subsets by their sum."""
    return rounded(st.counted_permutation_test(samples(spark, sf_dir), ["grp"], "x", F.col("first"), 100.0, "id"), "difference", "p")


@query(
    f"""WITH v AS (SELECT o_custkey AS grp, o_totalprice AS x, o_orderstatus = 'F' AS first, o_orderkey AS id FROM orders), g AS (SELECT grp, count(*) AS n, count(*) FILTER (first) AS n1, sum(x) AS t, sum(x) FILTER (first) AS s, list(x ORDER BY x) AS xs FROM v GROUP BY grp HAVING count(*) <= 10 AND count(*) FILTER (first) BETWEEN 1 AND count(*) - 1),
w AS (SELECT *, list_sum([xs[i] * ((k >> (i - 1)) & 1) FOR i IN range(1, n + 1)]) AS drawn FROM g, range(0, 1024) q(k) WHERE k < (1 << n::INT) AND bit_count(k::INT) = n1)
SELECT grp, max(n) AS n, round(max(s / n1 - (t - s) / (n - n1)), 6) + 0.0 AS difference, round(count(*) FILTER (abs(drawn / n1 - (t - drawn) / (n - n1)) >= abs(s / n1 - (t - s) / (n - n1)) - 1e-9) / count(*)::DOUBLE, 6) AS p FROM w GROUP BY grp"""
)
def perm_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact permutation tests of customers' finished orders against their others, for customers of at most ten orders."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_totalprice").alias("x"), (F.col("o_orderstatus") == "F").alias("first"))
    return rounded(st.exact_permutation_test(rows, ["grp"], "x", F.col("first"), 10, 0.01), "difference", "p")


PAIRS = darling("SELECT l_returnflag AS grp, x FROM d")


@query(
    f"""WITH d AS (SELECT l_returnflag, avg(l_quantity) FILTER (l_linenumber <= 3) - avg(l_quantity) FILTER (l_linenumber > 3) AS x FROM lineitem GROUP BY l_returnflag, l_suppkey), {PAIRS},
n AS (SELECT l_returnflag AS grp, x AS d, abs(x) AS size FROM d WHERE x <> 0), r AS (SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY size) + (count(*) OVER (PARTITION BY grp, size) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY grp, size) AS ties FROM n),
w AS (SELECT grp, count(*)::DOUBLE AS n, coalesce(sum(k) FILTER (d > 0), 0) AS w, sum(ties * ties - 1)::DOUBLE AS tied FROM r GROUP BY grp), t AS (SELECT l_returnflag AS grp, avg(x) / (stddev_samp(x) / sqrt(count(x))) AS t FROM d GROUP BY 1),
sz AS (SELECT grp, (w - n * (n + 1) / 4 - sign(w - n * (n + 1) / 4) * 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48) AS z FROM w), j AS (SELECT ad.grp, coalesce(a2 * (1 + 0.75 / n + 2.25 / (n * n)) < 0.752, false) AS normal FROM ad)
SELECT j.grp, normal, CASE WHEN normal THEN 't' ELSE 'signed rank' END AS test, round(CASE WHEN normal THEN t.t ELSE sz.z END, 6) + 0.0 AS stat FROM j JOIN t USING (grp) LEFT JOIN sz USING (grp)"""
)
def sig_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test a paired difference of low and high levels calls for, by flag, and its statistic."""
    low = F.col("l_linenumber") <= 3
    d = F.avg(F.when(low, F.col("l_quantity"))) - F.avg(F.when(~low, F.col("l_quantity")))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), "l_suppkey").agg(d.alias("x"))
    return rounded(st.significant_shift(rows, ["grp"], "x").select("grp", "normal", "test", "stat"), "stat")


@query(
    f"""WITH s AS (SELECT l_suppkey AS grp, count(*) AS n, regr_slope(l_extendedprice / 1000, l_quantity) AS slope, regr_sxx(l_extendedprice / 1000, l_quantity) AS sxx, regr_syy(l_extendedprice / 1000, l_quantity) AS syy FROM lineitem GROUP BY 1),
e AS (SELECT grp, n, slope, sqrt(greatest(syy - slope * slope * sxx, 0) / (n - 2) / sxx) AS se, n - 2 AS df FROM s), dfs AS (SELECT DISTINCT df FROM e WHERE df > 0), qs AS (SELECT df, {quantile_sql("df")} AS z FROM dfs),
q AS (SELECT e.*, se * z AS wide FROM e LEFT JOIN qs USING (df))
SELECT grp, n, round(slope, 6) + 0.0 AS slope, round(slope - wide, 6) + 0.0 AS slope_low, round(slope + wide, 6) + 0.0 AS slope_high, 1.0 BETWEEN slope - wide AND slope + wide AS includes FROM q"""
)
def ols_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence interval of each cell's slope, and whether it includes 1."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    found = st.slope_interval(st.least_squares(rows, ["grp"], F.col("l_quantity"), F.col("y")))
    return rounded(found.select("grp", "n", "slope", "slope_low", "slope_high", "includes"), "slope", "slope_low", "slope_high")


BAND = """v AS (SELECT o_orderpriority AS grp, {x} AS x, {y} AS y FROM orders),
s AS (SELECT grp, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS b0, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) / sum(x * x) AS slope0, avg(x) AS x_mean, min(x) AS x_low, max(x) AS x_high FROM v GROUP BY 1),
qs AS (SELECT DISTINCT n - {less} AS df FROM s), q AS (SELECT df, {z} AS z FROM qs),
p AS (SELECT s.*, q.z, k AS point, {start} + (x_high - {start}) * k / 24 AS x FROM s JOIN q ON q.df = s.n - {less}, range(0, 25) r(k)),
l AS (SELECT grp, point, x, {line} AS y, z * {se} AS wide FROM p)
SELECT grp, point, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(y - wide, 6) + 0.0 AS low, round(y + wide, 6) + 0.0 AS high FROM l"""


@query("WITH " + BAND.format(x="log10(o_custkey + 1)", y="log10(o_totalprice)", less=2, z=quantile_sql("df"), start="(CASE WHEN x_low > 0 THEN x_low ELSE 0 END)", line="b0 + slope * x", se="sqrt((syy - slope * slope * sxx) / (n - 2)) * sqrt(1.0 / n + (x - x_mean) * (x - x_mean) / sxx)"))
def ols_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of order values by customer number, both on log scales, with the bands of their means, by priority."""
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "grp")
    fit = st.least_squares(rows, ["grp"], F.col("o_custkey") + 1, F.col("o_totalprice"), log_scale=True)
    return rounded(st.line_band(fit, ["grp"], 25), "x", "y", "low", "high")


@query("WITH " + BAND.format(x="o_custkey::DOUBLE", y="o_totalprice / 1000", less=1, z=quantile_sql("df"), start="0.0", line="slope0 * x", se="sqrt((yy - slope0 * slope0 * xx) / (n - 1)) * abs(x) / sqrt(xx)"))
def ols_origin_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the origin, on plain scales."""
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "grp")
    fit = st.least_squares(rows, ["grp"], F.col("o_custkey").cast("double"), F.col("o_totalprice") / 1000)
    return rounded(st.line_band(fit, ["grp"], 25, intercept=False), "x", "y", "low", "high")


TUNED = """m AS (SELECT l_suppkey AS cell, l_linenumber <= 3 AS pre, month(l_shipdate) AS freq, avg(l_extendedprice) AS r FROM lineitem GROUP BY ALL),
bf AS (SELECT cell, pre, freq FROM m QUALIFY row_number() OVER (PARTITION BY cell, pre ORDER BY r DESC, freq) = 1),
level AS (SELECT l_suppkey AS cell, avg(l_extendedprice) FILTER (l_linenumber <= 3) AS before, avg(l_extendedprice) FILTER (l_linenumber > 3) AS later FROM lineitem GROUP BY 1),
cells AS (SELECT a.cell, abs(log2(b.freq / a.freq::DOUBLE)) <= 0.25 AS grp, later / before AS ratio, log2(later / before) AS x FROM bf a JOIN bf b ON b.cell = a.cell AND NOT b.pre JOIN level ON level.cell = a.cell WHERE a.pre)"""


@query(
    f"""WITH {TUNED}, {darling("SELECT grp, x FROM cells")},
n AS (SELECT grp, x AS d, abs(x) AS size FROM cells WHERE x <> 0), r AS (SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY size) + (count(*) OVER (PARTITION BY grp, size) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY grp, size) AS ties FROM n),
w AS (SELECT grp, count(*)::DOUBLE AS n, coalesce(sum(k) FILTER (d > 0), 0) AS w, sum(ties * ties - 1)::DOUBLE AS tied FROM r GROUP BY grp),
sz AS (SELECT grp, (w - n * (n + 1) / 4 - sign(w - n * (n + 1) / 4) * 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48) AS z FROM w),
t AS (SELECT grp, count(x) AS n, avg(ratio) AS ratio, avg(x) / nullif(stddev_samp(x) / sqrt(count(x)), 0) AS t, count(x) - 1 AS df FROM cells GROUP BY 1),
j AS (SELECT t.*, z, coalesce(a2 * (1 + 0.75 / ad.n + 2.25 / (ad.n * ad.n)) < 0.752, false) AS normal FROM t JOIN ad USING (grp) LEFT JOIN sz USING (grp)),
p AS (SELECT *, CASE WHEN normal THEN {two_sided_sql("t", "df")} ELSE 2 * {tail_sql("z")} END AS p FROM j)
SELECT grp AS tuned, n, round(ratio, 6) + 0.0 AS ratio, CASE WHEN normal THEN 't' ELSE 'signed rank' END AS test, round(CASE WHEN normal THEN t ELSE z END, 6) + 0.0 AS stat, round(p, 6) + 0.0 AS p, coalesce(p < 0.05, false) AS sig FROM p"""
)
def tuned_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much cells change from low to high levels, apart for those whose best frequency stays within a quarter octave, tested against no change."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), (F.col("l_linenumber") <= 3).alias("pre"), F.month("l_shipdate").alias("freq"), F.col("l_extendedprice").alias("v"))
    means = rows.groupBy("cell", "pre", "freq").agg(F.avg("v").alias("r")).groupBy("cell").agg(*[F.max(F.when(F.col("pre") == when, F.struct("r", (-F.col("freq")).alias("f"))))["f"].alias(name) for name, when in (("before_f", True), ("later_f", False))])
    level = rows.groupBy("cell").agg((F.avg(F.when(~F.col("pre"), F.col("v"))) / F.avg(F.when(F.col("pre"), F.col("v")))).alias("ratio"))
    cells = means.join(level, "cell").where("before_f IS NOT NULL AND later_f IS NOT NULL")
    cells = cells.select((F.abs(F.log2(F.col("later_f") / F.col("before_f"))) <= 0.25).alias("tuned"), "ratio", F.log2("ratio").alias("x"))
    found = st.significant_shift(cells, ["tuned"], "x").select("tuned", "test", "stat", "p", "sig")
    sizes = cells.groupBy("tuned").agg(F.count("x").alias("n"), F.avg("ratio").alias("ratio"))
    return rounded(sizes.join(found, "tuned").select("tuned", "n", "ratio", "test", "stat", "p", "sig"), "ratio", "stat", "p")
