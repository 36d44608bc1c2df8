"""From recordings as they lie in a folder to named conditions, traces and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators import relations, roi
from tracemill.operators.filters import zero_phase


class NotOne(ValueError):
    """None or several where exactly one is required."""


def only_row(rows: DataFrame, what: str) -> DataFrame:
    """The distinct rows if there is exactly one; raises NotOne otherwise."""
    found = rows.distinct().limit(2).collect()
    if len(found) != 1:
        raise NotOne(f"{what}: {'none' if not found else 'several, such as ' + ' and '.join(str(tuple(x)) for x in found)}")
    return rows.sparkSession.createDataFrame(found, rows.schema)


def columns_left(rows: DataFrame, taken: list[str]) -> list[str]:
    """Columns that are not among those taken, in their order."""
    return [c for c in rows.columns if c not in taken]


def canonical(rows: DataFrame, source: str, name: str = "f") -> DataFrame:
    """``source`` under its canonical name; an error that says what there is if it is missing."""
    if source not in rows.columns:
        raise ValueError(f"no column {source}; there are {', '.join(rows.columns)}")
    return rows.withColumnRenamed(source, name)


def condition_label(number: Column, first_post: Column, drug: Column, is_map: Column) -> Column:
    """pre or post and the drug, or none where there is none; recordings of response maps are marked."""
    label = F.when(drug.isNull() | (drug == ""), F.lit("none")).otherwise(F.concat(F.when(number >= first_post, F.lit("post")).otherwise(F.lit("pre")), drug))
    return F.concat(label, F.when(is_map, F.lit(" FRAmap")).otherwise(F.lit("")))


def condition_name(label: Column, rows: Column, columns: Column, zoom: Column, main_zoom: Column) -> Column:
    """A valid name of letters, digits and underscores: the label, the frame's size, and the zoom where it is not the main one."""
    plain = zoom.cast("double")
    number = F.when(plain == F.floor(plain), F.floor(plain).cast("string")).otherwise(plain.cast("string"))
    text = F.concat(F.format_string("%s_%dx%d", label, rows, columns), F.when(zoom == main_zoom, F.lit("")).otherwise(F.concat(F.lit("_z"), number)))
    valid = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    return F.when(valid.rlike("^[A-Za-z]"), valid).otherwise(F.concat(F.lit("x"), valid))


def kept_zooms(recordings: DataFrame, zoom: str, most_dropped: int = 2, keep_others: bool = False) -> DataFrame:
    """Recordings at the most common zoom; those at others are left out where they are few, and by default where they are more."""
    main = F.broadcast(relations.most_common(recordings, zoom).select(F.col(zoom).alias("main_zoom")))  # one row
    marked = recordings.join(main)
    others = marked.agg(F.count_if(F.col(zoom) != F.col("main_zoom")).alias("others"))
    return marked.join(F.broadcast(others)).where((F.col(zoom) == F.col("main_zoom")) | (F.lit(keep_others) & (F.col("others") > most_dropped))).drop("others")


def numeric_suffix(name: Column) -> Column:
    """The number at a name's end: cell10 comes after cell9."""
    return F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")).cast("long")


def merged_groups(traces: DataFrame, manifest: DataFrame, separated: DataFrame, scale: float = 0.8) -> DataFrame:
    """(tif, cell, frame, f): raw traces less a share of what exceeds the separated ones, matched by name through the manifest.

    ``traces`` (tif, cell, frame, raw), ``manifest`` (group, trial, tif),
    ``separated`` (group, cell, trial, frame, sep) with cells and trials as names
    that end in their number from 0. A recording that the manifest lacks is an error.
    """
    relations.require_partners(traces.select("tif").distinct(), manifest, ["tif"])
    numbered = separated.select("group", (numeric_suffix(F.col("cell")) + 1).alias("cell"), (numeric_suffix(F.col("trial")) + 1).alias("trial"), "frame", "sep")
    found = traces.join(manifest.select("tif", "group", F.col("trial").cast("long").alias("trial")), "tif").join(numbered, ["group", "cell", "trial", "frame"])
    return found.select("tif", "cell", "frame", (F.col("raw") - F.lit(scale) * (F.col("raw") - F.col("sep"))).alias("f"))


def split_trials(rows: DataFrame, group: list[str], order: str, is_map: Column) -> DataFrame:
    """Trials of maps and of stimuli apart, each numbered anew from 1 in their order: (..., is_map, trial)."""
    marked = rows.withColumn("is_map", is_map)
    return marked.withColumn("trial", F.row_number().over(Window.partitionBy(*group, "is_map").orderBy(order)))


def pieces_of(name: Column, lengths: Column) -> Column:
    """The substrings of a name that have one of the ``lengths``."""
    n = F.length(name)
    at = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda a: F.substring(name, a, k))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda k: k <= n), at)))


def containing_matches(wanted: DataFrame, sources: DataFrame, name: str, source: str) -> DataFrame:
    """(name, n, source): the source whose name holds the other's or is held by it, NULL unless there is one.

    Names are taken apart and joined on equality, so no pair is tried; a name gives
    pieces of the other side's lengths alone.
    """
    a, b = wanted.select(name).distinct().where(F.length(name) > 0), sources.select(source).distinct().where(F.length(source) > 0)
    apart = lambda whole, other, c, k: whole.join(F.broadcast(other.agg(F.array_sort(F.collect_set(F.length(k))).alias("_lengths")))).select(c, F.explode(pieces_of(F.col(c), F.col("_lengths"))).alias(k))  # noqa: E731  one row of lengths
    held = apart(b, a, source, name).join(a, name)
    holding = apart(a, b, name, source).join(b, source)
    pairs = held.select(name, source).union(holding.select(name, source)).distinct()
    return wanted.select(name).distinct().join(pairs, name, "left").groupBy(name).agg(F.count(source).alias("n"), F.when(F.count(source) == 1, F.min(source)).alias(source))


def resolved_sets(names: DataFrame, sets: DataFrame, group: str, set_id: str, tif: str, rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, set_id): the one set that has all of a group's recordings, else the one with as many regions as the group has rows.

    ``rows`` (group, n) and ``sizes`` (set_id, n); groups without exactly one set are an error.
    """
    holding = relations.containing_sets(names, sets, group, set_id, tif)
    one = holding.groupBy(group).agg(F.count("*").alias("k"), F.min(set_id).alias(set_id)).where("k = 1").select(group, set_id)
    rest = rows.join(one, group, "left_anti").join(sizes, "n").groupBy(group).agg(F.count("*").alias("k"), F.min(set_id).alias(set_id)).where("k = 1").select(group, set_id)
    found = one.union(rest)
    relations.require_partners(names.select(group).distinct(), found, [group])
    return found


def extracted_traces(stack: DataFrame, recordings: DataFrame, masks: DataFrame, group: str, tif: str, columns: int, pixels: tuple[str, ...] = ("px",)) -> DataFrame:
    """(group, tif, roi, frame, one mean for each of ``pixels``, n_frames, rate): masked means of a joined stack, frame by frame, traced back to recordings.

    ``stack`` (group, frame, pixel columns such as corrected and raw), ``recordings``
    (group, tif, n_frames, rate), ``masks`` (group, roi, row, col, deleted).
    """
    ranges = relations.frame_ranges(recordings, [group], [tif], "n_frames")
    own = relations.located(stack.select(group, "frame"), ranges, [group], "frame", [tif, "n_frames", "rate"])
    found = roi.masked_means(stack, masks, [group, "frame"], [group, "roi"], columns, pixels)
    return found.join(own, [group, "frame"]).select(group, tif, "roi", F.col("own_frame").alias("frame"), *[f"f_{x}" for x in pixels], "n_frames", "rate")


def mean_of_recordings(traces: DataFrame, cell: list[str], tif: str, value: str) -> DataFrame:
    """(frame, n, mean): cells' means over recordings, then the mean over cells."""
    each = traces.groupBy(*cell, "frame").agg(F.avg(value).alias("m"))
    return each.groupBy("frame").agg(F.count("m").alias("n"), F.avg("m").alias("mean"))


def change_map(frames: DataFrame, group: list[str], columns: int, base: tuple[int, int], after: tuple[int, int], order: int = 2, cutoff: float = 0.25, pixels: str = "px") -> DataFrame:
    """(group, row, col, change): each pixel's (F - F0) / F0, filtered over time without a shift, as its mean over the frames ``after``."""
    long = frames.select(*group, "frame", F.posexplode(pixels).alias("at", "v"))
    keys = [*group, "at"]
    f0 = long.where(F.col("frame").between(*base)).groupBy(*keys).agg(F.avg("v").alias("f0"))
    change = long.join(f0, keys).select(*keys, "frame", F.try_divide(F.col("v") - F.col("f0"), F.col("f0")).alias("v"))
    found = zero_phase(change, keys, order, cutoff).groupBy(*keys).agg(F.avg(F.when(F.col("frame").between(*after), F.col("v"))).alias("change"))
    return found.select(*group, (F.floor(F.col("at") / columns) + 1).cast("int").alias("row"), (F.col("at") % columns + 1).alias("col"), "change")


def filled_runs(groups: DataFrame, image_counts: DataFrame, image: str) -> DataFrame:
    """(image, n_roi, run, warn): separation runs by number of regions, largest first; a single run has no number, and a count of files that differs is marked.

    ``groups`` (image, n_roi, n_tifs), ``image_counts`` (image, found). Runs are as
    many as different numbers of regions.
    """
    runs = groups.select("n_roi").distinct().withColumn("run", F.row_number().over(Window.orderBy(F.desc("n_roi"))))
    several = F.broadcast(runs.agg((F.count("*") > 1).alias("several")))
    marked = groups.join(runs, "n_roi").join(several).join(image_counts, image, "left")
    return marked.select(image, "n_roi", F.when(F.col("several"), F.concat(F.lit("g"), F.col("run"))).alias("run"), (~F.col("n_tifs").eqNullSafe(F.col("found"))).alias("warn"))
