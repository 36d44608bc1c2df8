"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash, of its id and text. A source takes all documents whose hash
lies below its threshold, beside whole extra passes. The threshold is found
without sorting: words are summed by source and 12 hash bits, the bucket where
the running sum passes the budget is refined by the next 12 bits, and so on, each
pass over the rows of the boundary buckets alone. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import WORD, settled, stage, staged

HASH_BITS, STEP_BITS = 60, 12


#: Tasks over which rows that agree in source, id and text are counted.
SHARES = 64


def leading_bits(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, src, size, digest, own, share) -> the same with rank instead of share: from 1 for the rows that agree in source, id and text.

    Copies are interchangeable, so that any ranks of theirs make the same mix. A group
    of copies may hold most rows: it is dealt into shares, each ranked by itself after
    the rows of the shares before it, of which counts alone are added up.
    """
    counts = rows.groupBy("src", "digest", "share").agg(F.count("*").alias("n"))
    copied = stage(counts.groupBy("src", "digest").agg(F.sum("n").alias("all")).where("all > 1").select(F.col("src").alias("of"), F.col("digest").alias("copied")), "mix-copied")
    same = F.col("src").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("copied"))
    alone = rows.join(copied, same, "left_anti").withColumn("rank", F.lit(1).cast("long"))
    before = Window.partitionBy("src", "digest").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)  # SHARES rows at most
    offsets = counts.join(copied, same, "left_semi").select(F.col("src").alias("of"), F.col("digest").alias("copied"), F.col("share").alias("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("src", "digest", "share").orderBy("own"))
    several = rows.join(copied, same, "left_semi").withColumn("nth", inside)
    several = several.join(offsets, same & (F.col("share") == F.col("part"))).withColumn("rank", F.col("offset") + F.col("nth"))
    names = ["doc_id", "src", "size", "digest", "own", "rank"]
    return alone.select(*names).union(several.select(*names))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(src, source_size) -> target, filling sources up to ``most`` times their size.

    The sources whose cap lies below their weighted share form a prefix in the
    order of cap by weight, so running sums find the level at once. One row a
    source: windows over them all are as small as the list of sources.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    ranked = ranked.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("capped", F.col("cap") <= F.col("weight") * level)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.try_divide(left, free))
    return ranked.select("src", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, ..., passes, bound, last): whole passes, and the hash below which a document is taken once more."""
    passes = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).cast("long")
    budgets = stage(targets.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-budgets")
    path = budgets.select("src", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        p = path.alias("p")
        inside = sized.alias("s").join(p, F.col("s.src").eqNullSafe(F.col("p.src")) & (F.shiftright("s.hash", shift + STEP_BITS) == F.col("p.prefix")))
        histogram = inside.groupBy(F.col("s.src").alias("src"), "rest", "base", F.shiftright("s.hash", shift).alias("child")).agg(F.sum("s.size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("src").orderBy("child").rowsBetween(Window.unboundedPreceding, 0))
        counted = histogram.withColumn("upto", F.col("base") + upto)
        around = counted.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("words") > 0))
        path = stage(around.select("src", "rest", F.col("child").alias("prefix"), (F.col("upto") - F.col("words")).alias("base"), "upto"), "mix-path")
    nearer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("base"))
    ends = path.select(F.col("src").alias("end_src"), F.col("prefix").alias("bound"), nearer.alias("last"))
    return stage(budgets.join(ends, F.col("src").eqNullSafe(F.col("end_src")), "left").drop("end_src", "rest"), "mix-bounds")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """What each document gives to the mix: (doc_id, size, source_size, target, taken, src, own).

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all words; a target stops at ``most`` times its source's size.
    Null and empty texts have size 0 and give 0 words; a null source is a source
    of its own; a null id is the empty string. Rows are hashed by id and text, and
    those of a source that agree in both by a rank as well, so that rows that share
    an id, or have none, are taken each by itself; own is the text's hash. An empty
    table gives no rows.
    """
    begun = staged()
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).cast("int")
    read = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), size.alias("size"), digest.alias("digest"), F.xxhash64(text).alias("own"), dealt.alias("share")), "mix-read")
    ranked = ranked_copies(read).withColumn("hash", leading_bits(F.md5(F.concat("digest", F.lit(":"), F.col("rank").cast("string")))))
    sized = stage(ranked.select("doc_id", "src", "size", "hash", "own"), "mix-sizes")
    sizes = stage(sized.groupBy("src").agg(F.sum("size").alias("source_size")), "mix-sources")
    bounds = thresholds(sized, source_targets(sizes, weights, share, most)).withColumnRenamed("src", "bound_src")
    below = (F.col("hash") < F.col("bound")) | ((F.col("hash") == F.col("bound")) & F.col("last"))
    taken = F.col("size") * (F.col("passes") + F.coalesce(below, F.lit(False)).cast("long"))
    joined = sized.join(bounds, F.col("src").eqNullSafe(F.col("bound_src")))
    return settled(joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "src", "own"), "mix", begun)


ORACLE = r"""
WITH read AS (
  SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest
  FROM documents),
sized AS (SELECT doc_id, src, size, ('0x' || substr(md5(digest || ':' || row_number() OVER (PARTITION BY src, digest)), 1, 15))::BIGINT AS hash FROM read),
sizes AS (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget, row_number() OVER (ORDER BY src NULLS LAST) AS rank
  FROM sizes),
levels AS (
  SELECT *, cap <= weight * ((budget - coalesce(sum(cap) OVER before, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE))) AS capped
  FROM ranked WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT src, source_size, CASE WHEN capped THEN cap ELSE weight * ((budget - coalesce(sum(cap) FILTER (capped) OVER (), 0.0::DOUBLE)) / nullif(sum(weight) FILTER (NOT capped) OVER (), 0)) END AS target
  FROM levels),
budgets AS (SELECT *, floor(coalesce(target / nullif(source_size, 0), 0))::BIGINT AS passes FROM targets),
running AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.passes, b.target - b.passes * b.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.src ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.src, s.hash) AS words
  FROM sized s JOIN budgets b ON s.src IS NOT DISTINCT FROM b.src)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN upto <= rest THEN 1 WHEN upto - words <= rest AND upto - rest < rest - (upto - words) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""
