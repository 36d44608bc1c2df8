"""Structured Streaming over arriving samples: an extension, as the batch operators work on closed files.

A stream of (cell, stim, ts, value) can be reduced to closed time windows, or each
cell's running baseline and peak can be kept as state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.shipping import ship

PEAKS = "cell long, stim string, n long, pk double, threshold double, sig boolean"
STATE = "n long, total double, squares double, pk double"


def samples(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    ship(spark)
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def window_means(stream: DataFrame, ts: str, keys: list[str], value: str, length: str, late: str) -> DataFrame:
    """(keys, start, n, mean) of tumbling windows; samples later than ``late`` are not waited for."""
    timed = stream.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), *keys)
    found = timed.agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return found.select(*keys, F.col("w.start").alias("start"), "n", "mean")


def running_peaks(stream: DataFrame, baseline: int, sd: float = 2.0) -> DataFrame:
    """After each micro-batch, the peak so far of every (cell, stim) against its first ``baseline`` samples.

    State is four numbers a key, so it is bounded by the number of keys.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, squares, pk = state.get if state.exists else (0, 0.0, 0.0, -math.inf)
        for batch in batches:
            for v in batch.sort_values(["ts", "event_id"])["value"].dropna():
                n += 1
                if n <= baseline:
                    total, squares = total + v, squares + v * v
                else:
                    pk = max(pk, v)
        state.update((n, total, squares, pk))
        used = min(n, baseline)
        mean = total / used if used else math.nan
        spread = math.sqrt(max(squares - used * mean * mean, 0.0) / (used - 1)) if used > 1 else 0.0
        limit = mean + sd * spread
        yield pd.DataFrame({"cell": [key[0]], "stim": [key[1]], "n": [n], "pk": [pk if n > baseline else None], "threshold": [limit], "sig": [bool(n > baseline and pk >= limit)]})

    return stream.groupBy("cell", "stim").applyInPandasWithState(update, PEAKS, STATE, "update", GroupStateTimeout.NoTimeout)


def append_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, one Parquet folder per micro-batch; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
