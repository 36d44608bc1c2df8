"""Contiguous shards of equal bytes by global prefix sums.

Rows are put in order of id by a range exchange that moves ids, sizes and hashes
alone. Each partition sums the bytes before each of its rows; the partitions'
totals, summed in order, say how many bytes lie before each partition. A row's
global prefix is the sum of both, and cutting it at equal targets gives the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import inner_id, outer_id, settled, stage, staged
from tracemill.shipping import ship

#: Bytes that a row takes beside its text.
OVERHEAD = 16
#: Rows that a partition of the order holds, about; its total is one row.
PER_PART = 1 << 18
ORDERED = "_id long, size long, text_crc32 long, own long, part int, bytes_before long, rows_before long"


def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with its number and the bytes and rows before them in it."""
    part, before, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column(1).to_numpy()
        upto = np.cumsum(size)
        n = len(size)
        columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(upto - size + before), pa.array(np.arange(rows, rows + n))]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ORDERED.split(", ")])
        before, rows = before + int(upto[-1]) if n else before, rows + n


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD, per_part: int = PER_PART) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, own) of every row.

    Rows are ordered by id, null first, then by the text's hash; a shard is a range
    of that order. With T bytes in all, a row goes to the shard in whose T / shards
    bytes its middle lies, so that a shard's size differs from T / shards by at most
    half a row at each end; one that a row larger than a share spans may stay empty.
    ``slot`` counts from 0 inside a shard. Null and empty texts have no bytes but the
    ``overhead``. Rows that agree in id and text are interchangeable and lie side by
    side. law is ``bytes`` and grown_shard null. own is the hash of the text. An
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    begun = staged()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(inner_id(id_col).alias("_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("own"))
    rows = stage(rows, "shard-sizes")
    parts = max(1, -(-rows.count() // per_part), docs.sparkSession.sparkContext.defaultParallelism)
    # repeated ids and texts are dealt out by where they were read, which changes no result
    ordered = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, "_id", "own", "salt").sortWithinPartitions("_id", "own", "salt").drop("salt")
    ordered = stage(ordered.mapInArrow(prefixed, ORDERED), "shard-order")
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    offsets = F.broadcast(stage(offsets, "shard-offsets"))  # one row a partition, of ``per_part`` rows each
    cut = F.expr(f"(2 * (bytes + bytes_before) + size) * {shards:d} div (2 * total)").cast("int")  # whole numbers, up to 10^17 bytes
    placed = ordered.join(offsets, "part").select("_id", "size", "text_crc32", "own", cut.alias("shard"), (F.col("rows") + F.col("rows_before")).alias("row"))
    firsts = stage(placed.groupBy("shard").agg(F.min("row").alias("first")), "shard-firsts")
    out = placed.join(F.broadcast(firsts), "shard")  # one row a shard
    out = out.select(outer_id().alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "own")
    return settled(out, "shards", begun)


#: crc32 is spelt out by bytes, each looked up in a table that is built by the same rule.
ORACLE = r"""
WITH bits AS (SELECT list(list_reduce([n] || [0::BIGINT FOR k IN range(8)], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))) ORDER BY n) AS own FROM (SELECT unnest(range(256))::BIGINT AS n)),
sized AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row, hex(encode(coalesce(text, ''))) AS digits FROM documents),
crcs AS (
  SELECT doc_id, size, row,
         xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || [('0x' || substr(digits, (2 * k + 1)::BIGINT, 2))::BIGINT FOR k IN range(size - 16)], lambda c, b: xor(c >> 8, own[xor(c & 255, b) + 1]))) AS text_crc32
  FROM sized, bits),
placed AS (SELECT *, floor((2 * sum(size) OVER (ORDER BY row) - size)::HUGEINT * 40 // (2 * sum(size) OVER ()))::INTEGER AS shard FROM crcs)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row - min(row) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM placed
"""
