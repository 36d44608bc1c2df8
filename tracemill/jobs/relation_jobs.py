"""Lining up: joins, sets, keys and scan geometry over customers, orders, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.jobs.registry import query, r6, table
from tracemill.operators import relations


@query("SELECT o_orderkey AS tif, o_custkey AS cell, c_acctbal AS bf FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0")
def cohort_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with their cell's best frequency, for cells with a positive score."""
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tif"), F.col("o_custkey").alias("cell"))
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("bf"))
    return relations.with_dimension(facts, cells, ["cell"], ["bf"], F.col("bf") > 0).select("tif", "cell", "bf")


@query("SELECT o_orderkey AS tif, o_orderstatus AS stim FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_stim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that have a pulse of the family."""
    legend = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("tif"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tif"), F.col("o_orderstatus").alias("stim")).join(legend, "tif", "left_semi")


@query("SELECT c_custkey AS cell FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without any recording of a condition."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("cell"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell")).join(seen, "cell", "left_anti")


@query("SELECT o_custkey AS cell FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def roi_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells found in all three conditions."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderstatus").alias("condition"))
    return relations.in_all_conditions(rows, ["cell"], "condition", ["F", "O", "P"])


@query(
    """WITH g AS (SELECT DISTINCT n_regionkey AS grp, n_nationkey AS m FROM nation ), s AS (SELECT DISTINCT c_mktsegment || ':' || floor(c_acctbal / 10000)::BIGINT AS sid, c_nationkey AS m FROM customer)
SELECT DISTINCT g.grp, s.sid FROM g JOIN s USING (m) WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.grp = g.grp AND NOT EXISTS (SELECT 1 FROM s t WHERE t.sid = s.sid AND t.m = h.m))"""
)
def contains_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets that contain every member of a group."""
    groups = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("m"))
    sets = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(":"), F.floor(F.col("c_acctbal") / 10000)).alias("sid"), F.col("c_nationkey").alias("m"))
    return relations.containing_sets(groups, sets, "grp", "sid", "m")


@query(
    "SELECT o_orderkey AS tif, dense_rank() OVER (ORDER BY o_orderpriority)::INT AS animal_no, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey)::INT AS roi_no FROM orders WHERE o_orderpriority IS NOT NULL AND o_custkey IS NOT NULL"
)
def rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animals numbered from 1, and cells from 1 within each animal."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tif"), F.col("o_orderpriority").alias("animal"), F.col("o_custkey").alias("roi"))
    return relations.dense_keys(rows, "animal", "roi").select("tif", F.col("outer_no").alias("animal_no"), F.col("inner_no").alias("roi_no"))


RECORDINGS = "rec AS (SELECT o_custkey AS grp, o_orderkey AS tif, 20 + o_orderkey % 30 AS n FROM orders), ranges AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY tif) AS last, sum(n) OVER (PARTITION BY grp ORDER BY tif) - n + 1 AS first FROM rec)"


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("tif"), (20 + F.col("o_orderkey") % 30).alias("n"))
    return relations.frame_ranges(rows, ["grp"], ["tif"], "n")


@query(f"WITH {RECORDINGS} SELECT grp, tif, first::BIGINT AS first_frame, last::BIGINT AS last_frame FROM ranges")
def frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that each recording takes in its group's joined stack."""
    return recordings(spark, sf_dir).select("grp", "tif", "first_frame", "last_frame")


@query(f"WITH {RECORDINGS}, p AS (SELECT DISTINCT l_suppkey AS grp, 1 + l_partkey % 400 AS frame FROM lineitem) SELECT p.grp, p.frame, r.tif, (p.frame - r.first + 1)::BIGINT AS own_frame FROM p JOIN ranges r ON r.grp = p.grp AND p.frame BETWEEN r.first AND r.last")
def frame_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of joined stacks traced back to their recording."""
    frames = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), (1 + F.col("l_partkey") % 400).alias("frame")).distinct()
    return relations.located(frames, recordings(spark, sf_dir), ["grp"], "frame", ["tif"]).select("grp", "frame", "tif", "own_frame")


@query(
    """WITH g AS (SELECT p_size % 4 AS h, p_partkey % 3 AS zoom, count(*) AS n, min(p_partkey) AS seen FROM part GROUP BY ALL) SELECT h, zoom, n, row_number() OVER (ORDER BY seen)::INT AS geometry_no FROM g"""
)
def geom_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct scan geometries in order of first appearance."""
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("h"), (F.col("p_partkey") % 3).alias("zoom"), "p_partkey")
    return relations.geometries(rows, ["h", "zoom"], "p_partkey")


@query(
    """WITH z AS (SELECT p_size AS zoom, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, zoom LIMIT 1), s AS (SELECT p_brand AS geometry, p_size AS zoom, count(*) AS n, max(p_retailprice) AS area, min(p_partkey) AS seen FROM part GROUP BY ALL)
SELECT s.geometry, s.zoom, s.area FROM s JOIN z USING (zoom) ORDER BY area DESC, seen LIMIT 1"""
)
def main_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest geometry at the most common zoom, the first seen on ties."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("geometry"), F.col("p_size").alias("zoom"), "p_retailprice", "p_partkey")
    zoom = relations.most_common(part, "zoom").select("zoom")
    found = part.join(zoom, "zoom").groupBy("geometry", "zoom").agg(F.max("p_retailprice").alias("area"), F.min("p_partkey").alias("seen"))
    return found.orderBy(F.desc("area"), "seen").limit(1).select("geometry", "zoom", "area")


@query("SELECT 'customer' AS animal, c_nationkey AS roi, c_acctbal AS f FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of all animals stacked, columns by name."""
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("animal"), F.col("c_nationkey").alias("roi"), F.col("c_acctbal").alias("f"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("f"), F.lit("supplier").alias("animal"), F.col("s_nationkey").alias("roi"))
    return a.unionByName(b)


@query(
    """WITH w AS (SELECT DISTINCT p_brand AS name, split_part(p_brand, '#', 2) AS k FROM part), s AS (SELECT n_name AS source, split_part(n_name, '_', 2) AS k FROM nation)
SELECT w.name, count(s.source) AS n, CASE WHEN count(s.source) = 1 THEN min(s.source) END AS source FROM w LEFT JOIN s USING (k) GROUP BY w.name"""
)
def crop_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cropped condition with the one source that its name points to; the part in common is the join key, so no pair is tried."""
    wanted = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct().withColumn("k", F.split_part("name", F.lit("#"), F.lit(2)))
    sources = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.split_part("n_name", F.lit("_"), F.lit(2)).alias("k2"))
    return relations.unique_matches(wanted, sources, "name", "source", F.col("k") == F.col("k2")).select("name", "n", "source")


@query(
    """SELECT l_suppkey AS roi, round(avg(l_extendedprice) FILTER (l_returnflag = 'A'), 4) + 0.0 AS a, round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 4) + 0.0 AS r, bool_and(l_discount > 0.09) FILTER (l_linenumber = 7) AND count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'R')) = 2 AS all_sig FROM lineitem GROUP BY 1"""
)
def contrast_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell with a column for each contrast, and whether it is significant throughout."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("roi"), F.col("l_returnflag").alias("contrast"), "l_extendedprice", "l_discount", "l_linenumber")
    mean = lambda c: F.round(F.avg(F.when(F.col("contrast") == c, F.col("l_extendedprice"))), 4)
    both = F.bool_or(F.col("contrast") == "A") & F.bool_or(F.col("contrast") == "R")
    sig = F.bool_and(F.when(F.col("l_linenumber") == 7, F.col("l_discount") > 0.09)) & both
    return rows.groupBy("roi").agg(mean("A").alias("a"), mean("R").alias("r"), sig.alias("all_sig"))


@query("WITH s AS (SELECT l_orderkey AS image, count(l_linenumber) AS n_items FROM lineitem GROUP BY 1) SELECT n_items, count(*) OVER (PARTITION BY n_items) AS n, image FROM s")
def roi_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images grouped by how many regions they hold."""
    return relations.grouped_by_size(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), "l_linenumber"), "image", "l_linenumber")


@query("SELECT o_custkey AS series, o_orderkey AS number, coalesce(lag(o_orderkey) OVER w, -1) AS before, coalesce(lead(o_orderkey) OVER w, -1) AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def neighbour_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next and the previous existing file of each series, -1 where there is none."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("number"))
    return relations.neighbours(rows, ["series"], "number").na.fill(-1, ["before", "after"])


@query(
    """WITH roi AS (SELECT DISTINCT l_suppkey AS roi FROM lineitem), stim AS (SELECT DISTINCT l_shipdate.year() AS y, l_returnflag AS flag FROM lineitem), t AS (SELECT l_suppkey AS roi, year(l_shipdate) AS y, l_returnflag AS flag, count(*) AS reps, avg(l_quantity) AS f FROM lineitem GROUP BY ALL)
SELECT roi.roi, stim.y::INT AS y, stim.flag, coalesce(reps, 0) AS reps, round(f, 6) + 0.0 AS f FROM roi CROSS JOIN stim LEFT JOIN t ON t.roi = roi.roi AND t.y = stim.y AND t.flag = stim.flag""".replace("l_shipdate.year()", "year(l_shipdate)")
)
def roi_by_stim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell by every stimulus, with its repetitions; stimuli that a cell missed have none.

    The list of stimuli is one row, so each cell carries it and explodes it.
    """
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("roi"), F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("flag"), "l_quantity")
    seen = rows.groupBy("roi", "y", "flag").agg(F.count("*").alias("reps"), r6(F.avg("l_quantity")).alias("f"))
    stimuli = seen.select("y", "flag").distinct().agg(F.collect_list(F.struct("y", "flag")).alias("stimuli"))
    full = seen.select("roi").distinct().join(F.broadcast(stimuli)).select("roi", F.explode("stimuli").alias("s")).select("roi", "s.y", "s.flag")
    return full.join(seen, ["roi", "y", "flag"], "left").withColumn("reps", F.coalesce("reps", F.lit(0)))
