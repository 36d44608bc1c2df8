"""Joins, sets and keys that line recordings, cells and stimuli up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MissingKey(ValueError):
    """Rows whose key has no partner where every key must have one."""


def require_partners(rows: DataFrame, partners: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` if every key of theirs is among the partners; raises MissingKey otherwise."""
    lost = rows.join(partners.select(*keys), keys, "left_anti").select(*keys).limit(3).collect()
    if lost:
        raise MissingKey(f"no partner for {', '.join(str(tuple(x)) for x in lost)}")
    return rows


def first_match(rows: DataFrame, keys: list[str], order: list[str], test: Column | None = None) -> DataFrame:
    """For each key the first row by ``order`` that passes the test; keys without one are left out."""
    passing = rows if test is None else rows.where(test)
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return passing.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*rows.columns)


def with_dimension(facts: DataFrame, dimension: DataFrame, keys: list[str], columns: list[str], test: Column) -> DataFrame:
    """Inner join with the dimension's rows that pass ``test``, of which only ``columns`` come along."""
    return facts.join(dimension.where(test).select(*keys, *columns), keys, "inner")


def in_all_conditions(rows: DataFrame, keys: list[str], condition: str, conditions: list) -> DataFrame:
    """Keys that every one of the conditions has."""
    return rows.where(F.col(condition).isin(*conditions)).groupBy(*keys).agg(F.count_distinct(condition).alias("n")).where(F.col("n") == len(conditions)).select(*keys)


def intersected(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, tables)


def containing_sets(groups: DataFrame, sets: DataFrame, group: str, set_id: str, member: str) -> DataFrame:
    """(group, set_id): sets that contain every member of a group. Counted over equal members, so no pair of group and set without a common one is ever made."""
    wanted = groups.select(group, member).distinct()
    sizes = wanted.groupBy(group).agg(F.count("*").alias("size"))
    common = wanted.join(sets.select(set_id, member).distinct(), member).groupBy(group, set_id).agg(F.count("*").alias("common"))
    return common.join(sizes, group).where(F.col("common") == F.col("size")).select(group, set_id)


def dense_keys(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Rows with outer_no, and inner_no within it: dense numbers from 1 in order of the keys.

    Only the distinct keys are numbered; rows with a NULL key are left out.
    """
    keys = rows.where(F.col(outer).isNotNull() & F.col(inner).isNotNull()).select(outer, inner).distinct()
    outers = keys.select(outer).distinct().withColumn("outer_no", F.row_number().over(Window.orderBy(outer)))
    numbered = keys.withColumn("inner_no", F.row_number().over(Window.partitionBy(outer).orderBy(inner))).join(outers, outer)
    return rows.join(numbered, [outer, inner])


def ordered_stimuli(rows: DataFrame, params: list[str]) -> DataFrame:
    """(params, stim_id): distinct stimuli numbered from 1 in falling order of all parameters, the treatment first."""
    return rows.select(*params).distinct().withColumn("stim_id", F.row_number().over(Window.orderBy(*[F.col(c).desc() for c in params])))


def frame_ranges(recordings: DataFrame, group: list[str], order: list[str], frames: str) -> DataFrame:
    """Recordings with the first and last frame that they take in their group's joined stack."""
    so_far = F.sum(frames).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return recordings.withColumn("last_frame", so_far).withColumn("first_frame", F.col("last_frame") - F.col(frames) + 1)


def located(frames: DataFrame, ranges: DataFrame, group: list[str], frame: str, columns: list[str]) -> DataFrame:
    """Each frame of a joined stack with its recording: a merge of range starts and frames in order, not a range join.

    Starts and frames of a group are sorted together and the last start is carried
    forward, so the work is a sort, whatever the number of recordings.
    """
    starts = ranges.select(*group, F.col("first_frame").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.struct(*columns, "first_frame", "last_frame").alias("_start"), F.lit(None).cast("long").alias("_frame"))
    points = frames.select(*group, F.col(frame).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_start"].dataType).alias("_start"), F.col(frame).cast("long").alias("_frame"))
    order = Window.partitionBy(*group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.union(points).withColumn("_in", F.last("_start", ignorenulls=True).over(order)).where("_kind = 1 AND _frame <= _in.last_frame")
    return found.select(*group, F.col("_frame").alias(frame), *[F.col(f"_in.{c}").alias(c) for c in columns], (F.col("_frame") - F.col("_in.first_frame") + 1).alias("own_frame"))


def geometries(recordings: DataFrame, geometry: list[str], order: str) -> DataFrame:
    """(geometry, n, geometry_no): distinct scan geometries in order of first appearance."""
    found = recordings.groupBy(*geometry).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return found.withColumn("geometry_no", F.row_number().over(Window.orderBy("first_seen"))).drop("first_seen")


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """One row (column, n): the most frequent value, the smallest on ties."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1)


def unique_matches(wanted: DataFrame, sources: DataFrame, name: str, source: str, key: Column) -> DataFrame:
    """(name, source) of sources whose key equals the name's; names with none or several are marked by n."""
    return wanted.join(sources, key, "left").groupBy(name).agg(F.count(source).alias("n"), F.when(F.count(source) == 1, F.min(source)).alias(source))


def grouped_by_size(rows: DataFrame, owner: str, item: str) -> DataFrame:
    """(n_items, n, owner): each owner with the number of its items and how many owners hold as many; no list of owners is gathered."""
    sizes = rows.groupBy(owner).agg(F.count(item).alias("n_items"))
    return sizes.join(sizes.groupBy("n_items").agg(F.count("*").alias("n")), "n_items").select("n_items", "n", owner)


def neighbours(files: DataFrame, group: list[str], number: str) -> DataFrame:
    """The next and the previous existing file number of each."""
    own = Window.partitionBy(*group).orderBy(number)
    return files.select(*group, number, F.lag(number).over(own).alias("before"), F.lead(number).over(own).alias("after"))
