"""What stacks of images are to the trace jobs: headers, channels, and recordings cut out of joined stacks.

Files are read by ``stacks``; an inventory that asks for paths and lengths alone never
touches the contents. Header text is split into keys and values; it is never evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import relations
from tracemill.sources.stacks import stacks, write_stacks

#: Names of what a header tells, in the newer dialect (tag Software) and in the older one (tag ImageDescription).
NEWER = {"rate": "SI.hRoiManager.scanFrameRate", "zoom": "SI.hRoiManager.scanZoomFactor", "rows": "SI.hRoiManager.linesPerFrame", "cols": "SI.hRoiManager.pixelsPerLine", "fast": "SI.hRoiManager.scanAngleMultiplierFast", "slow": "SI.hRoiManager.scanAngleMultiplierSlow", "shift_x": "SI.hRoiManager.scanAngleShiftFast", "shift_y": "SI.hRoiManager.scanAngleShiftSlow", "rotation": "SI.hRoiManager.scanRotation", "n_frames": "SI.hScan2D.logFramesPerFile"}
OLDER = {"rate": "state.acq.frameRate", "zoom": "state.acq.zoomFactor", "rows": "state.acq.linesPerFrame", "cols": "state.acq.pixelsPerLine", "fast": "state.acq.scanAngleMultiplierFast", "slow": "state.acq.scanAngleMultiplierSlow", "shift_x": "state.acq.scanShiftFast", "shift_y": "state.acq.scanShiftSlow", "rotation": "state.acq.scanRotation", "n_frames": "state.acq.numberOfFrames"}


def inventory(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """(path, name, length, likely_map): what is there, by metadata alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", (F.col("length") > 11_000_000).alias("likely_map"))


def with_header_fields(rows: DataFrame, description: Column, software: Column) -> DataFrame:
    """``rows`` and what a header's text says, newer dialect or older: frame rate, zoom, size, scan geometry, frames and saved channels; NULL where it does not say.

    Both texts are taken apart once per row, not once for each field.
    """
    split = rows.withColumns({"_newer": header_map(software), "_older": header_map(description)})
    at = lambda text, name: F.try_element_at(text, F.lit(name))
    out = {k: F.coalesce(at("_newer", NEWER[k]), at("_older", NEWER[k]), at("_older", OLDER[k])).try_cast("double") for k in NEWER}
    saved = F.coalesce(at("_newer", "SI.hChannels.channelSave"), at("_older", "SI.hChannels.channelSave"))
    out["channels"] = F.coalesce(F.size(F.regexp_extract_all(saved, F.lit(r"\d+"), 0)), at("_older", "state.acq.numberOfChannelsSave").try_cast("int"))
    return split.withColumns(out).drop("_newer", "_older")


def headers(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """(path, h, w, the fields of ``with_header_fields``, copyright) of every file, from its first directory alone."""
    read = stacks(spark, folder, "headers", pattern)
    return with_header_fields(read, F.col("description"), F.col("software")).select("path", "h", "w", *NEWER, "channels", "copyright")


def image_counts(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """(path, images) of every file, from its chain of directories."""
    return stacks(spark, folder, "counts", pattern)


def split_channels(spark: SparkSession, folder: str, out: str, channels: int, pattern: str = "*.tif") -> None:
    """A file ``<name>_chan_<n>.tif`` for each channel of each stack, marked as such in its copyright tag."""
    read = frames(spark, folder, channels, pattern)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.tif$", "")
    write_stacks(read, out, F.concat(name, F.lit("_chan_"), F.col("chan").cast("string"), F.lit(".tif")), "frame", split_note(F.col("chan")))


def split_note(chan: Column) -> Column:
    """The mark of a file that holds one channel of another."""
    return F.concat(F.lit("splitTif_channel_"), chan.cast("string"))


def cut_back(stack: DataFrame, recordings: DataFrame, group: str, tif: str) -> DataFrame:
    """(tif, frame, h, w, px): a joined stack taken apart into its recordings by their numbers of frames."""
    ranges = relations.frame_ranges(recordings, [group], [tif], "n_frames")
    own = relations.located(stack.select(group, "frame"), ranges, [group], "frame", [tif])
    return stack.join(own, [group, "frame"]).select(tif, F.col("own_frame").alias("frame"), "h", "w", "px")


def frames(spark: SparkSession, folder: str, channels: int = 1, pattern: str = "*.tif") -> DataFrame:
    """(path, chan, frame, h, w, px): one row per image of every file."""
    chan, frame = channel_of(F.col("image"), channels)
    return stacks(spark, folder, "frames", pattern).select("path", chan.alias("chan"), frame.alias("frame"), "h", "w", "px")


def channel_of(image: Column, channels: int) -> tuple[Column, Column]:
    """Channel and frame, from 1, of an image number in a stack of interleaved channels."""
    return ((image - 1) % channels + 1).cast("int"), (F.floor((image - 1) / channels) + 1).cast("int")


def header_map(text: Column) -> Column:
    """Lines ``key = value`` as a map; the last of a repeated key holds.

    Sorted by key and line, so that a line is compared with the next one only; a
    lambda's body is evaluated for each element, so the lines are handed to it ready.
    """
    lines = F.filter(F.split(text, r"[\r\n]+"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x, i: F.struct(F.trim(F.regexp_extract(x, r"^([^=]*)=", 1)).alias("k"), i.alias("i"), F.trim(F.regexp_extract(x, r"=(.*)$", 1)).alias("v")))
    last = lambda p: F.filter(p, lambda q, i: ~F.get(p, i + 1)["k"].eqNullSafe(q["k"]))
    entries = lambda p: F.transform(last(p), lambda q: F.struct(q["k"], q["v"]))
    return F.map_from_entries(F.transform(F.array(F.array_sort(pairs)), entries)[0])
