"""Regions of interest as rows of pixels (row, col), and traces out of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outline(pixels: DataFrame, roi: list[str]) -> DataFrame:
    """(roi, row, col): the first and last pixel of each column and of each row, each point once."""
    columns = pixels.groupBy(*roi, "col").agg(F.min("row").alias("a"), F.max("row").alias("b")).select(*roi, F.explode(F.array("a", "b")).alias("row"), "col")
    rows = pixels.groupBy(*roi, "row").agg(F.min("col").alias("a"), F.max("col").alias("b")).select(*roi, "row", F.explode(F.array("a", "b")).alias("col"))
    return columns.unionByName(rows).distinct()


def on_curve(points: DataFrame, roi: list[str]) -> DataFrame:
    """(roi, n, ring): outline points by angle about their centre, closed by the first; ``ring`` as row:col text.

    An outline is bounded by the frame's size, so its points fit one array.
    """
    centre = points.groupBy(*roi).agg(F.avg("row").alias("r0"), F.avg("col").alias("c0"))
    turned = points.join(centre, roi).withColumn("turn", F.round(F.atan2(F.col("col") - F.col("c0"), F.col("row") - F.col("r0")), 9))
    ring = F.array_sort(F.collect_list(F.struct("turn", "row", "col")))
    text = F.transform(ring, lambda x: F.concat_ws(":", x["row"], x["col"]))
    return turned.groupBy(*roi).agg(F.count("*").alias("n"), text.alias("ring")).select(*roi, "n", F.array_join(F.concat("ring", F.slice("ring", 1, 1)), " ").alias("ring"))


def cropped(pixels: DataFrame, roi: list[str], first_row: int, last_row: int, margin: int = 0) -> DataFrame:
    """Regions that lie wholly inside the rows first_row..last_row less a margin, in the crop's coordinates."""
    inside = pixels.groupBy(*roi).agg(F.min("row").alias("top"), F.max("row").alias("bottom")).where((F.col("top") >= first_row + margin) & (F.col("bottom") <= last_row - margin))
    return pixels.join(inside.select(*roi), roi, "left_semi").withColumn("row", F.col("row") - first_row + 1)


def masked_means(frames: DataFrame, masks: DataFrame, frame: list[str], roi: list[str], columns: int, pixels: str | tuple[str, ...] = "px") -> DataFrame:
    """(frame, roi, f): mean of the pixels under each mask; a deleted mask keeps its row with NULL. Of several pixel columns each gives an f_<column>.

    Masks are one row per region with the positions of its pixels, so frames are
    never exploded into pixels. ``masks`` has the frame's grouping column in common
    (a NULL mask list marks a deleted region).
    """
    indexed = masks.groupBy(*roi).agg(F.collect_list(F.when(~F.col("deleted"), (F.col("row") - 1) * columns + F.col("col"))).alias("at"))

    def mean(name: str) -> Column:
        chosen = F.transform("at", lambda i: F.element_at(F.col(name), i.cast("int")).cast("double"))
        return F.try_divide(F.aggregate(chosen, F.lit(0.0), lambda acc, v: acc + v), F.size("at"))

    common = [c for c in roi if c in frames.columns]
    means = [mean(pixels).alias("f")] if isinstance(pixels, str) else [mean(x).alias(f"f_{x}") for x in pixels]
    return frames.join(indexed, common).select(*dict.fromkeys([*frame, *roi]), *means)


def mean_image(frames: DataFrame, group: list[str], columns: int, pixels: str = "px") -> DataFrame:
    """(group, row, col, f): mean over frames of each pixel."""
    long = frames.select(*group, F.posexplode(pixels).alias("at", "v"))
    found = long.groupBy(*group, "at").agg(F.avg(F.col("v").cast("double")).alias("f"))
    return found.select(*group, (F.floor(F.col("at") / columns) + 1).cast("int").alias("row"), (F.col("at") % columns + 1).alias("col"), "f")


def lifted(frames: DataFrame, group: list[str], pixels: str = "px") -> DataFrame:
    """Frames less the least pixel of their group, so that nothing is negative."""
    low = frames.groupBy(*group).agg(F.min(F.array_min(pixels)).alias("_low"))
    return frames.join(low, group).withColumn(pixels, F.transform(pixels, lambda v: v - F.col("_low"))).drop("_low")


def boxed(at: Column, row: tuple[int, int], col: tuple[int, int], columns: int) -> Column:
    """Whether a position counted from 0 lies in a box of rows and columns counted from 1."""
    return (F.floor(at / columns) + 1).between(*row) & (at % columns + 1).between(*col)


def filled(vertices: DataFrame, roi: list[str]) -> DataFrame:
    """(roi, row, first, last): the pixels whose centres lie inside of polygons by the even-odd rule, as intervals of columns.

    ``vertices`` (roi, n, x, y), pixel centres at whole numbers from 1, in the order of n
    and closed from the last to the first. An edge crosses the rows from its upper end to
    before its lower one; crossings of a row, from left to right, open and close
    intervals in turn. Edges on a row cross none. Pixels left of an odd crossing are out,
    those on it in. Each edge is one row and each crossing one more, whatever a polygon's area.
    """
    ring = Window.partitionBy(*roi).orderBy("n")
    whole = Window.partitionBy(*roi)
    first = F.min_by(F.struct("x", "y"), "n").over(whole)
    after = F.coalesce(F.lead(F.struct("x", "y")).over(ring), first)
    edges = vertices.withColumn("to", after).where(F.col("y") != F.col("to.y"))
    top, low = F.least("y", "to.y"), F.greatest("y", "to.y")
    start, end = F.ceil(top).cast("int"), (F.ceil(low) - 1).cast("int")
    crossed = edges.where(start <= end).select(*roi, "x", "y", "to", F.explode(F.sequence(start, end)).alias("row"))
    at = F.col("x") + (F.col("row") - F.col("y")) * (F.col("to.x") - F.col("x")) / (F.col("to.y") - F.col("y"))
    across = Window.partitionBy(*roi, "row").orderBy("at")
    pairs = crossed.select(*roi, "row", at.alias("at")).withColumns({"nth": F.row_number().over(across), "until": F.lead("at").over(across)}).where("nth % 2 = 1")
    spans = pairs.select(*roi, "row", F.ceil("at").cast("int").alias("first"), F.floor("until").cast("int").alias("last"))
    return spans.where("first <= last")


def interval_means(frames: DataFrame, spans: DataFrame, frame: list[str], roi: list[str], columns: int, pixels: str = "px") -> DataFrame:
    """(frame, roi, f): means under masks of intervals, from differences of running sums, two look-ups an interval instead of one for each pixel.

    ``spans`` (roi, row, first, last) has the frame's grouping columns in common;
    intervals are cut at the image's sides.
    """
    cut = spans.select(*roi, (F.col("row") - 1).alias("row"), F.greatest("first", F.lit(1)).alias("first"), F.least("last", F.lit(columns)).alias("last")).where((F.col("first") <= F.col("last")) & (F.col("row") >= 0))
    listed = cut.groupBy(*roi).agg(F.collect_list(F.struct((F.col("row") * columns + F.col("first") - 1).alias("a"), (F.col("row") * columns + F.col("last")).alias("b"))).alias("spans"))
    # running sums by row, in long form, so that no sum is copied along
    long = frames.select(*frame, F.posexplode(pixels).alias("at", "v"))
    upto = F.sum("v").over(Window.partitionBy(*frame).orderBy("at"))
    sums = long.withColumn("s", upto.cast("double")).groupBy(*frame).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("sums"))
    common = [c for c in roi if c in frames.columns]
    joined = sums.join(listed, common) if set(common) <= set(frame) else sums.join(frames.select(*dict.fromkeys([*frame, *common])), frame).join(listed, common)
    size = F.size("sums")
    inside = F.filter("spans", lambda s: s["b"] <= size)
    upto_at = lambda k: F.when(k > 0, F.element_at("sums", F.greatest(k, F.lit(1)))).otherwise(0.0)
    total = F.aggregate(inside, F.lit(0.0), lambda acc, s: acc + upto_at(s["b"]) - upto_at(s["a"]))
    count = F.aggregate(inside, F.lit(0), lambda acc, s: acc + s["b"] - s["a"])
    return joined.select(*dict.fromkeys([*frame, *roi]), F.try_divide(total, count).alias("f"))


class Unmappable(ValueError):
    """A source and a target acquisition of which one is no clean crop of the other."""


def clean_crop(source: dict, target: dict) -> tuple[int, int]:
    """(rows, columns) that a centred crop leaves out at each side; raises Unmappable unless the two agree in all else.

    Headers have rows, cols, zoom, fast, shift_x, shift_y, rotation, pitch_x and
    pitch_y; a pitch is the field over its number of pixels, so a crop keeps it.
    """
    for k in ("zoom", "fast"):
        if abs(source[k] - target[k]) > 1e-9:
            raise Unmappable(f"{k} differs: {source[k]} and {target[k]}")
    for k in ("shift_x", "shift_y", "rotation"):
        if abs(source[k]) > 1e-9 or abs(target[k]) > 1e-9:
            raise Unmappable(f"{k} must be 0")
    for k in ("pitch_x", "pitch_y"):
        if abs(source[k] / target[k] - 1) > 1e-9:
            raise Unmappable(f"{k} differs: {source[k]} and {target[k]}")
    out = []
    for k in ("rows", "cols"):
        left = source[k] - target[k]
        if left < 0 or left % 2:
            raise Unmappable(f"{k}: {source[k]} cannot be cropped to {target[k]} about the centre")
        out.append(left // 2)
    return out[0], out[1]


def remapped(pixels: DataFrame, roi: list[str], source: dict, target: dict, margin: int = 0) -> DataFrame:
    """(roi, row, col) in the target's coordinates, of live regions that lie wholly inside of it less a margin; ids stay.

    ``pixels`` may have a column ``deleted``; deleted regions are left out.
    """
    up, left = clean_crop(source, target)
    live = pixels.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in pixels.columns else pixels
    box = live.groupBy(*roi).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    inside = box.where((F.col("r0") > up + margin) & (F.col("r1") <= up + target["rows"] - margin) & (F.col("c0") > left + margin) & (F.col("c1") <= left + target["cols"] - margin))
    kept = live.join(inside.select(*roi), roi, "left_semi")
    return kept.select(*roi, (F.col("row") - up).alias("row"), (F.col("col") - left).alias("col"))


def crop_sources(acquisitions: DataFrame, group: list[str]) -> DataFrame:
    """(group, condition, source, up, left, rows, cols): for each target acquisition the one that it takes its regions from.

    ``acquisitions`` (group, condition, has_rois, rows, cols, zoom, fast, shift_x,
    shift_y, rotation, pitch_x, pitch_y) are nodes; a clean centred crop of one with
    regions is an edge. A target, which has none of its own, takes the nearest: a source
    whose name holds its own or is held by it before others, then the one that the crop
    cuts least. No source at all, or two as near, raise Unmappable.
    """
    source = acquisitions.where("has_rois").select(*group, *[F.col(c).alias(f"s_{c}") for c in acquisitions.columns if c not in (*group, "has_rois")])
    target = acquisitions.where("NOT has_rois")
    s, t = (lambda c: F.col(f"s_{c}")), F.col
    still = [F.abs(t(c)) <= 1e-9 for c in ("shift_x", "shift_y", "rotation")] + [F.abs(s(c)) <= 1e-9 for c in ("shift_x", "shift_y", "rotation")]
    alike = [F.abs(s(c) - t(c)) <= 1e-9 for c in ("zoom", "fast")] + [F.abs(s(c) - t(c)) <= 1e-9 * F.abs(t(c)) for c in ("pitch_x", "pitch_y")]
    inside = [(s(c) >= t(c)) & ((s(c) - t(c)) % 2 == 0) for c in ("rows", "cols")]
    edges = target.join(source, group)
    for test in (*still, *alike, *inside):
        edges = edges.where(test)
    named = (s("condition").contains(t("condition")) | t("condition").contains(s("condition"))).cast("int")
    near = edges.withColumn("_near", F.struct((-named).alias("named"), (s("rows") * s("cols") - t("rows") * t("cols")).alias("cut")))
    least = near.groupBy(*group, "condition").agg(F.min("_near").alias("_near"))
    found = near.join(least, [*group, "condition", "_near"])
    doubtful = target.join(found, [*group, "condition"], "left").groupBy(*group, "condition").agg(F.count("s_condition").alias("n")).where("n <> 1").limit(3).collect()
    if doubtful:
        raise Unmappable("; ".join(f"{tuple(r)[:-1]}: {'no source of which it is a clean crop' if not r.n else f'{r.n} sources as near'}" for r in doubtful))
    return found.select(*group, "condition", s("condition").alias("source"), ((s("rows") - t("rows")) / 2).cast("int").alias("up"), ((s("cols") - t("cols")) / 2).cast("int").alias("left"), "rows", "cols")


def remapped_everywhere(pixels: DataFrame, acquisitions: DataFrame, group: list[str], roi: str, margin: int = 0) -> DataFrame:
    """(group, condition, source, roi, row, col): the live regions of all sources in the coordinates of all targets that hold them wholly, less a margin; ids stay.

    ``pixels`` (group, condition, roi, row, col, deleted). One plan for all conditions of
    all groups; the regions of a source go to each of its targets.
    """
    crops = crop_sources(acquisitions, group)
    live = pixels.where(~F.coalesce("deleted", F.lit(False))).withColumnRenamed("condition", "source")
    box = live.groupBy(*group, "source", roi).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    held = box.join(crops, [*group, "source"]).where((F.col("r0") > F.col("up") + margin) & (F.col("r1") <= F.col("up") + F.col("rows") - margin) & (F.col("c0") > F.col("left") + margin) & (F.col("c1") <= F.col("left") + F.col("cols") - margin))
    kept = live.join(held.select(*group, "condition", "source", roi, "up", "left"), [*group, "source", roi])
    return kept.select(*group, "condition", "source", roi, (F.col("row") - F.col("up")).alias("row"), (F.col("col") - F.col("left")).alias("col"))


def remapped_outlines(pixels: DataFrame, roi: list[str], source: dict, target: dict, margin: int = 0) -> DataFrame:
    """(roi, n, ring): outlines of the regions in the target's coordinates, worked out anew."""
    return on_curve(outline(remapped(pixels, roi, source, target, margin), roi), roi)
