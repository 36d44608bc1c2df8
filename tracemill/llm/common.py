"""What the training-data operators share: tables, staging, words and packed columns.

Words and n-gram hashes are computed once per Arrow batch with numpy. Where an
operator has to exchange one small entry for every word of the corpus, entries
travel as packed arrays, one row per (batch, bucket), because a row of its own
for each would multiply the shuffled bytes.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.shipping import ship

#: A null doc_id is handled as this smallest id and returned as null.
NO_ID = -(1 << 63)
#: Java form of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where one machine does all, it may be unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{configured or f'{tempfile.gettempdir()}/tracemill-checkpoints'}/tracemill"


class Staged(threading.local):
    """Tables that this thread has staged; queries that run at once in other threads have their own."""

    def __init__(self):
        self.paths: list[str] = []


_staged = Staged()


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def staged() -> int:
    """How many tables are staged, to be given to ``release`` as what came before."""
    return len(_staged.paths)


def release(spark: SparkSession, before: int, but: int = 0) -> None:
    """Delete the tables staged after the first ``before``, except the last ``but``; for when no plan reads them any more."""
    end = len(_staged.paths) - but
    for path in _staged.paths[before:end]:
        delete(spark, path)
    del _staged.paths[before:end]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, before: int) -> DataFrame:
    """A small result written to the shared folder, after which all that was staged for it since ``before`` is deleted."""
    out = stage(df, name)
    release(df.sparkSession, before, but=1)
    return out


def inner_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def outer_id(name: str = "_id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(_id, text) with null texts empty; of other columns those to ``carry`` come along as fields of rest, the others are left behind, whatever their names."""
    ship(docs.sparkSession)
    rest = [F.struct(*[F.col(c) for c in carry]).alias("rest")] if carry else []
    return docs.select(inner_id(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)


def row_keys(rows: DataFrame) -> DataFrame:
    """(key, _id, text, ...) of (_id, text, ...): the id itself, or where rows of other text repeat it, null ids too, a hash of id and text."""
    own = F.xxhash64("_id", "text")
    several = rows.groupBy("_id").agg(F.min(own).alias("least"), F.max(own).alias("most")).where("least <> most")
    several = stage(several.select("_id", F.lit(True).alias("several")), "repeated-ids")  # its size is known, so few ids move no texts
    return rows.join(several, "_id", "left").select(F.when(F.col("several"), own).otherwise(F.col("_id")).alias("key"), *rows.columns)


def buckets_for(docs: DataFrame, text_col: str, per_bucket: int, bytes_each: float) -> int:
    """A power of two, 128 at least: so many buckets that each gets about ``per_bucket`` entries, one for ``bytes_each`` bytes of text."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return 1 << max(7, int(total / bytes_each / per_bucket).bit_length())


class WordHashes(dict):
    """Remembers 64-bit hashes of recent words; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a polynomial hash."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive words, from the words' hashes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += words[k : len(words) - n + 1 + k]
    return mixed(total)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to about ``most_bytes`` of text, with the texts as UTF-8 bytes; whole texts always."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index("text"))
        lengths = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
        part = np.cumsum(lengths) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = batch.slice(a, b - a)
            yield piece, [x or b"" for x in piece.column(piece.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]


def binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary Arrow column whose row i holds ``data[starts[i]:starts[i+1]]``; starts ends with len(data)."""
    data = np.ascontiguousarray(data)
    offsets = (np.asarray(starts, np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)])).astype(np.int64)


def grouped_positions(ids: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """One row (_id, pos) per id, pos holding its uint32 positions."""
    order = np.lexsort((positions, ids))
    ids, positions = ids[order], positions[order].astype(np.uint32)
    starts = runs(ids)
    return pa.RecordBatch.from_arrays([pa.array(ids[starts[:-1]], pa.int64()), binaries(positions, starts)], ["_id", "pos"])


def per_document(found: DataFrame) -> DataFrame:
    """All packed positions of a document in one row; bounded by the document's own length."""
    return found.groupBy("_id").agg(F.collect_list("pos").alias("pos"))


def positions(packed: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(packed or ()), np.uint32).astype(np.int64)


PACKED = "bucket int, docs binary, counts binary, places binary, hashes binary"


def squeezed(values: np.ndarray) -> bytes:
    """Numbers as zstd of their byte planes, so that the high bytes of small ones cost nothing."""
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def restored(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def dealt(ids: np.ndarray, places: np.ndarray, hashes: np.ndarray, buckets: int, exact: bool = True, named: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket with its entries in order of document and place, the document once for all its entries.

    Places travel as differences. Not ``exact``: of a hash the 32 bits below the
    bucket's are sent, which is enough to rule most entries out. ``named`` are the
    documents' own ids, sent beside ``ids`` where those are keys.
    """
    bucket = bucket_of(hashes, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket, ids, places, hashes = bucket[order], ids[order], places[order], hashes[order]
    named = named if named is None else named[order]
    starts = runs(bucket)
    docs = np.union1d(runs(ids), starts)  # starts of the runs of one document in one bucket
    steps = np.diff(places, prepend=0)
    steps[docs[:-1]] = places[docs[:-1]]
    if not exact:
        hashes = (hashes >> np.uint64(64 - buckets.bit_length() + 1 - 32)).astype(np.uint32)
    inner = np.searchsorted(docs, starts)
    rows = []
    for a, b, i, j in zip(starts, starts[1:], inner, inner[1:], strict=False):
        own = ids[docs[i:j]].astype(np.int64)
        told = np.diff(own, prepend=np.int64(0))
        if named is not None:
            told = np.concatenate((told, named[docs[i:j]] - own))
        rows.append((int(bucket[a]), squeezed(told), squeezed(np.diff(docs[i : j + 1]).astype(np.uint32)), squeezed(steps[a:b].astype(np.uint32)), squeezed(hashes[a:b])))
    kinds = (pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PACKED.split(", ")])


def gathered(group: pa.Table, exact: bool = True, named: bool = False) -> tuple[np.ndarray, ...]:
    """ids, places and hashes of a bucket, and the documents' own ids if they were ``named``."""
    ids, places, hashes, names = [], [], [], []
    for row in group.select(["docs", "counts", "places", "hashes"]).to_pylist():
        own, counts = restored(row["docs"], np.int64), restored(row["counts"], np.uint32).astype(np.int64)
        own, off = own[: len(counts)], own[len(counts) :]
        own = np.cumsum(own)
        steps = restored(row["places"], np.uint32).astype(np.int64)
        first = np.cumsum(counts) - counts
        total = np.cumsum(steps)
        places.append(total - np.repeat(total[first] - steps[first], counts))
        ids.append(np.repeat(own, counts))
        hashes.append(restored(row["hashes"], np.uint64 if exact else np.uint32))
        if named:
            names.append(np.repeat(own + off, counts))
    return (*map(np.concatenate, (ids, places, hashes)), *([np.concatenate(names)] if named else []))
