"""Image stacks of any size as a data source: ranges of a file are read, frames are streamed to one.

``spark.read.format("stack")`` plans by file names and lengths alone. A partition is a
range of a file's bytes and holds the images whose directory starts in it: it follows
the chain of directories, of which it reads a few hundred bytes each, and fetches the
pixels of its own images. To read ``headers`` a partition is a run of files, of which
the first directory alone is read, however many images follow; ``counts`` follows the
chain without tags or pixels.

``df.write.format("stack")`` streams frames, in the order in which they come, each to
the file that it names. Files are written beside the folder's final names by task
attempt; the driver renames those of the attempts that Spark committed, and what other
attempts left goes with their folder. Paths are opened by pyarrow's file systems.
"""

from __future__ import annotations

import fnmatch
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tracemill.shipping import ship

FRAMES = "path string, image int, h int, w int, px array<short>"
COUNTED = "path string, images int"
HEADERS = "path string, h int, w int, bits int, description string, software string, copyright string"
WRITTEN = "file string, h int, w int, px array<short>, note string"
#: Tags of the TIFF format that uncompressed grey stacks use, and bytes and letters of its types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, SOFTWARE, FORMAT, COPYRIGHT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 305, 339, 33432
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: Bytes that are read where a directory is expected; a longer one is read in a second step.
PEEK = 512
#: Beyond this a classic file's 32-bit offsets may not reach.
CLASSIC = (1 << 32) - (1 << 24)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a URI as Spark writes it or a local path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, length) of the files below a folder, or of the file itself, whose names fit the pattern."""
    store, inner = opened(path)
    info = store.get_file_info(inner)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((prefix + x.path, x.size) for x in found if x.is_file and fnmatch.fnmatch(x.base_name, pattern) and not x.base_name.startswith(("_", ".")))


class StackFile:
    """Directories of an open stack, read by seeking."""

    def __init__(self, file: pa.NativeFile, length: int):
        self.file, self.length, self.fetched = file, length, 0
        head = self.bytes(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack(f"{self.order}H", head[2:4])[0] if self.order else 0
        if kind not in (42, 43):
            raise ValueError("not a TIFF file")
        wide = kind == 43
        self.count, self.offset, self.entry, self.inline = ("Q", "Q", 20, 8) if wide else ("H", "I", 12, 4)
        self.first = struct.unpack_from(f"{self.order}{self.offset}", head, 8 if wide else 4)[0]

    def bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(min(n, self.length - at))
        self.fetched += len(data)
        return data

    def directory(self, at: int) -> tuple[bytes, int]:
        """The entries of the directory at ``at`` and where the next one starts."""
        data, head = self.bytes(at, PEEK), struct.calcsize(self.count)
        n = struct.unpack_from(f"{self.order}{self.count}", data)[0]
        whole = head + self.entry * n + struct.calcsize(self.offset)
        if whole > len(data):
            data = self.bytes(at, whole)
        return data[head : head + self.entry * n], struct.unpack_from(f"{self.order}{self.offset}", data, whole - struct.calcsize(self.offset))[0]

    def tags(self, entries: bytes) -> dict[int, tuple]:
        out = {}
        for own in range(0, len(entries), self.entry):
            tag, kind, count = struct.unpack_from(f"{self.order}HH{self.offset}", entries, own)
            size, letter = TYPES.get(kind, (0, ""))
            if not size:
                continue
            form = f"{self.order}{count}{letter}"
            place = own + self.entry - self.inline
            if size * count > self.inline:
                out[tag] = struct.unpack(form, self.bytes(struct.unpack_from(f"{self.order}{self.offset}", entries, place)[0], size * count))
            else:
                out[tag] = struct.unpack_from(form, entries, place)
        return out

    def chain(self) -> Iterator[tuple[int, int, bytes]]:
        """(image number from 1, place, entries) of all directories; one that leads back to another is an error."""
        at, k, seen = self.first, 0, set()
        while at:
            if at in seen:
                raise ValueError("the directories of a stack form a ring")
            seen.add(at)
            entries, following = self.directory(at)
            k += 1
            yield k, at, entries
            at = following

    def image(self, tags: dict[int, tuple]) -> np.ndarray:
        if tags.get(COMPRESSION, (1,))[0] != 1:
            raise ValueError("compressed stacks cannot be read")
        data, places = b"", list(zip(tags[OFFSETS], tags[COUNTS], strict=True))
        while places:  # strips that follow one another are fetched at once
            at, n = places.pop(0)
            while places and places[0][0] == at + n:
                n += places.pop(0)[1]
            data += self.bytes(at, n)
        kind = np.dtype(np.uint8) if tags.get(BITS, (8,))[0] == 8 else np.dtype(np.int16).newbyteorder(self.order)
        return np.frombuffer(data, kind, tags[HEIGHT][0] * tags[WIDTH][0]).astype(np.int16)


def text_of(tags: dict[int, tuple], tag: int) -> str | None:
    return tags[tag][0].rstrip(b"\0").decode("utf-8", "replace") if tag in tags else None


def header_of(stack: StackFile) -> tuple:
    """The fields of HEADERS after the path, from the first directory."""
    tags = stack.tags(stack.directory(stack.first)[0]) if stack.first else {}
    return (*(tags.get(t, (None,))[0] for t in (HEIGHT, WIDTH, BITS)), *(text_of(tags, t) for t in (DESCRIPTION, SOFTWARE, COPYRIGHT)))


def frame_batches(path: str, stack: StackFile, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """FRAMES of the images whose directory lies in a range of the file."""
    rows, held = [], 0
    for k, at, entries in stack.chain():
        if start <= at < end:
            tags = stack.tags(entries)
            pixels = stack.image(tags)
            rows.append((path, k, tags[HEIGHT][0], tags[WIDTH][0], pixels))
            held += pixels.nbytes
            if held >= 8 << 20:
                yield batch_of(rows, FRAMES)
                rows, held = [], 0
    if rows:
        yield batch_of(rows, FRAMES)


@dataclass
class Range(InputPartition):
    path: str
    length: int
    start: int
    end: int


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "array<short>": pa.list_(pa.int16())}
    columns = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])


class StackReader(DataSourceReader):
    """Options: path, pattern (``*.tif``), what (frames, headers or counts), split (bytes of a range of frames, 256 MiB), files (a partition's files otherwise, 16)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*.tif")
        self.what = options.get("what", "frames")
        self.split, self.group = int(options.get("split", 256 << 20)), int(options.get("files", 16))

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path, self.pattern)
        if self.what != "frames":
            return [Files(files[k : k + self.group]) for k in range(0, len(files), self.group)]
        return [Range(path, n, at, min(n, at + self.split)) for path, n in files for at in range(0, n, self.split)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Range):
            store, inner = opened(partition.path)
            with store.open_input_file(inner) as file:
                yield from frame_batches(partition.path, StackFile(file, partition.length), partition.start, partition.end)
            return
        rows = []
        for path, length in partition.files:
            store, inner = opened(path)
            with store.open_input_file(inner) as file:
                stack = StackFile(file, length)
                rows.append((path, *header_of(stack)) if self.what == "headers" else (path, sum(1 for _ in stack.chain())))
        if rows:
            yield batch_of(rows, HEADERS if self.what == "headers" else COUNTED)


def directory_bytes(at: int, shape: tuple[int, int], texts: dict[int, bytes], wide: bool, last: bool) -> tuple[bytes, int]:
    """A directory at ``at`` with its texts, before its pixels and with the next one after them, and the length of both."""
    h, w = shape
    head, offset, entry, inline = ("Q", "Q", 20, 8) if wide else ("H", "I", 12, 4)
    entries = [(WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, 16), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (SAMPLES, 3, 1), (ROWS, 4, h), (FORMAT, 3, 2), (OFFSETS, 16 if wide else 4, None), (COUNTS, 16 if wide else 4, 2 * h * w), *((t, 2, x) for t, x in texts.items())]
    size = struct.calcsize(f"<{head}{offset}") + entry * len(entries)
    body = b"".join(x + b"\0" * (len(x) % 2) for x in texts.values() if len(x) > inline)
    pixels, place, out = at + size + len(body), at + size, struct.pack(f"<{head}", len(entries))
    for tag, kind, value in sorted(entries, key=lambda e: e[0]):
        if kind == 2:
            out += struct.pack(f"<HH{offset}", tag, kind, len(value))
            if len(value) > inline:
                where = at + size + body.index(value)
                out += struct.pack(f"<{offset}", where)
            else:
                out += value.ljust(inline, b"\0")
        else:
            value = pixels if value is None else value
            out += struct.pack(f"<HH{offset}", tag, kind, 1) + struct.pack(f"<{TYPES[kind][1]}", value).ljust(inline, b"\0")
    total = place + len(body) + 2 * h * w - at
    return out + struct.pack(f"<{offset}", 0 if last else at + total) + body, total


class StackStream:
    """One file: frames are written as they come, the last one when it is known to be the last, so that nothing is patched."""

    def __init__(self, file: pa.NativeFile, wide: bool):
        self.file, self.wide, self.waiting = file, wide, None
        self.file.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if wide else struct.pack("<2sHI", b"II", 42, 8))
        self.at = 16 if wide else 8

    def add(self, image: np.ndarray, texts: dict[int, bytes]) -> None:
        self.flush(last=False)
        self.waiting = image, texts

    def flush(self, last: bool) -> None:
        if self.waiting is not None:
            image, texts = self.waiting
            data, total = directory_bytes(self.at, image.shape, texts, self.wide, last)
            self.at += total
            if not self.wide and self.at > 1 << 32:
                raise ValueError("a classic stack cannot pass 4 GiB; write it with the option wide")
            self.file.write(data)
            self.file.write(np.ascontiguousarray(image, "<i2").tobytes())
            self.waiting = None

    def close(self) -> None:
        self.flush(last=True)
        self.file.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    attempt: str


class CommittedFiles(DataSourceArrowWriter):
    """Files written by task attempts beside their final names, which the driver gives to those that Spark committed."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def attempt(self, context: TaskContext) -> tuple[fs.FileSystem, str]:
        """The file system and a folder of this attempt alone."""
        store, folder = opened(self.path)
        return store, f"{folder}/{self.job}/{context.partitionId()}-{context.taskAttemptId()}"

    def checked(self, name: str | None, files: list[str]) -> str:
        if name in files or not name or "/" in name or name.startswith(("_", ".")):
            raise ValueError(f"not a file's name, or its rows do not come together: {name}")
        return name

    def commit(self, messages: list[Written | None]) -> None:
        """Rename what the committed attempts wrote; two that wrote one file, or a file that is there already, undo all."""
        store, folder = opened(self.path)
        done = [m for m in messages if m is not None and m.files]
        names = [n for m in done for n in m.files]
        there = {} if self.overwrite else {x.base_name for x in store.get_file_info([f"{folder}/{n}" for n in names]) if x.is_file}
        if len(set(names)) < len(names) or there:
            self.abort(messages)
            raise ValueError(f"files written twice: {sorted(there or {n for n in names if names.count(n) > 1})[:3]}")
        for m in done:
            for name in m.files:
                store.move(f"{m.attempt}/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        if store.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.job}")


class StackWriter(CommittedFiles):
    """Options: path (the folder), wide (64-bit offsets, false). Frames of a file must come together and in order."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        super().__init__(options, overwrite)
        self.wide = options.get("wide", "false").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, attempt = self.attempt(TaskContext.get())
        files: list[str] = []
        stream: StackStream | None = None
        try:
            for batch in iterator:
                for name, h, w, px, note in zip(*(batch.column(c).to_pylist() for c in ("file", "h", "w")), batch.column("px"), batch.column("note").to_pylist(), strict=True):
                    if not files or name != files[-1]:
                        name = self.checked(name, files)
                        if stream:
                            stream.close()
                        if not files:
                            store.create_dir(attempt, recursive=True)
                        files.append(name)
                        stream = StackStream(store.open_output_stream(f"{attempt}/{name}"), self.wide)
                    stream.add(np.asarray(px.values).reshape(h, w), {COPYRIGHT: note.encode() + b"\0"} if note else {})
            if stream:
                stream.close()
        except BaseException:
            if stream:
                stream.file.close()
            if files:
                store.delete_dir(attempt)
            raise
        return Written(files, attempt)


class StackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stack"

    def schema(self) -> str:
        return {"frames": FRAMES, "headers": HEADERS, "counts": COUNTED}[self.options.get("what", "frames")]

    def reader(self, schema: StructType) -> StackReader:
        return StackReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> StackWriter:
        return StackWriter(dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the ``stack`` format known to it."""
    ship(spark)
    spark.dataSource.register(StackSource)
    return spark


def stacks(spark: SparkSession, folder: str, what: str = "frames", pattern: str = "*.tif", split: int = 256 << 20) -> DataFrame:
    """FRAMES, HEADERS or COUNTED of the files of a folder, whatever their length.

    Where pyarrow cannot open the store, Spark's own reader brings whole files, each of
    2 GiB at most, and the same directories are read out of them.
    """
    try:
        opened(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        ship(spark)
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
        return files.select("path", "content").mapInArrow(whole(what), {"frames": FRAMES, "headers": HEADERS, "counts": COUNTED}[what])
    return registered(spark).read.format("stack").options(pattern=pattern, what=what, split=str(split)).load(folder)


def whole(what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer()
                stack = StackFile(pa.BufferReader(data), data.size)
                if what == "frames":
                    yield from frame_batches(path, stack, 0, data.size)
                elif what == "headers":
                    yield batch_of([(path, *header_of(stack))], HEADERS)
                else:
                    yield batch_of([(path, sum(1 for _ in stack.chain()))], COUNTED)

    return run


def write_stacks(frames: DataFrame, folder: str, file: str | Column, order: str | Column, note: Column | None = None, overwrite: bool = False) -> None:
    """Frames (h, w, px) as one stack a file: dealt by file, put in order, and streamed by the task that has them.

    Offsets have 64 bits if the largest file needs them.
    """
    name = F.col(file) if isinstance(file, str) else file
    size = frames.groupBy(name.alias("file")).agg(F.sum(2 * F.col("h").cast("long") * F.col("w") + 1024).alias("bytes"))
    wide = (size.agg(F.max("bytes")).first()[0] or 0) > CLASSIC
    rows = frames.select(name.alias("file"), F.col("h").cast("int"), F.col("w").cast("int"), F.col("px").cast("array<short>"), (F.lit(None).cast("string") if note is None else note).alias("note"), (F.col(order) if isinstance(order, str) else order).alias("_order"))
    dealt = rows.repartition("file").sortWithinPartitions("file", "_order").drop("_order")
    registered(frames.sparkSession)
    dealt.write.format("stack").mode("overwrite" if overwrite else "append").options(wide=str(wide).lower()).save(folder)
