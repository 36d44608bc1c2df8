"""The streaming extension over the events table, run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.jobs.registry import query, r6, shared_dir
from tracemill.streaming import online


@query(
    """WITH w AS (SELECT event_type AS stim, time_bucket(INTERVAL '1 hour', ts) AS start, count(value) AS n, avg(value) AS mean FROM events GROUP BY ALL)
SELECT stim, epoch_us(start) AS start_us, n, round(mean, 6) + 0.0 AS mean FROM w WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"""
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of each stimulus from a stream; windows that the watermark has closed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema.simpleString()[7:-1]
    schema = ", ".join(x.replace(":", " ", 1) for x in schema.split(","))
    stream = online.samples(spark, sf_dir, "events.parquet", schema)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    found = online.window_means(stream, "ts", ["event_type"], "value", "1 hour", "10 minutes")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    online.append_batches(found, f"{base}/out", f"{base}/state")
    rows = spark.read.schema("event_type string, start timestamp, n long, mean double").parquet(f"{base}/out")
    return rows.select(F.col("event_type").alias("stim"), F.unix_micros("start").alias("start_us"), "n", r6(F.col("mean")).alias("mean"))
