"""Raw camera movies and exported sound waveforms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.arrays import frame_times_from_zero
from tracemill.shipping import ship

MOVIE = "path string, frame int, h int, w int, px array<int>"


def movie_header(data: bytes) -> dict[str, str]:
    """``name: value`` lines up to the first empty one, units in brackets left out."""
    size = re.search(rb"Fixed[-_]Header[-_]Size:\s*(\d+)", data)
    text = data[: int(size[1]) if size else len(data)].replace(b"\r\n", b"\n").partition(b"\n\n")[0].decode("ascii", "replace")
    pairs = (line.partition(":") for line in text.split("\n") if ":" in line)
    return {name.strip().replace("-", "_"): value.partition("[")[0].strip() for name, _, value in pairs}


def movie_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_py()
            header = movie_header(data)
            skip, (_, _, w, h) = int(header["Fixed_Header_Size"]), (int(x) for x in header["ROI"].replace(",", " ").split()[:4])
            each = int(header["Frame_Size"])
            if each != 2 * w * h or (len(data) - skip) % each:
                raise ValueError(f"{path}: frames of {w} x {h} do not fill the file")
            for k in range((len(data) - skip) // each):
                pixels = np.frombuffer(data, "<u2", w * h, skip + k * each).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, k + 1, h, w, pixels), kinds, strict=True)], [x.split()[0] for x in MOVIE.split(", ")])


def movies(spark: SparkSession, folder: str, pattern: str = "*.qcamraw") -> DataFrame:
    """(path, frame, h, w, px): one row per frame, pixels row by row; a file whose size does not fit its header raises an error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(movie_frames, MOVIE)


def waveform_window(wave: Column, rate: Column, start: Column | float, end: Column | float) -> Column:
    """Samples of a waveform whose time, from 0, lies in start..end seconds, as an array of (t, v)."""
    times = frame_times_from_zero(F.size(wave), rate)
    return F.filter(F.arrays_zip(times.alias("t"), wave.alias("v")), lambda x: (x["t"] >= start) & (x["t"] <= end))
