"""Variables out of tagged, deflated container files (MAT-files of level 5), of which those not asked for are never inflated.

A file is a row of elements, each with its type and length. A variable's name stands in
the first bytes of its element, so that a reader inflates those, and passes over the
rest of it by its length unless the variable is wanted. Paths with dots reach into
structures. Files are found, opened and written as in ``stacks``.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tracemill.shipping import ship
from tracemill.sources.stacks import CommittedFiles, Files, Written, listed, opened

#: The format's types of stored numbers, of elements and of arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {1: "latin-1", 2: "latin-1", 4: "utf-16", 16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, DEFLATED = 14, 15
CELL, STRUCT, CHAR, DOUBLE = 1, 2, 4, 6
NUMERIC = range(6, 16)
HEADER = 128
#: Inflated bytes in which a variable's name is looked for, and deflated ones that are read at a time.
HEAD, CHUNK = 4096, 1 << 16
KINDS = {"double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


class Elements:
    """Elements of a block of bytes, one after another."""

    def __init__(self, data: bytes, order: str):
        self.data, self.order, self.at = data, order, 0

    def next(self) -> tuple[int, bytes]:
        kind, size = struct.unpack_from(f"{self.order}II", self.data, self.at)
        if kind >> 16:  # a short element: its length and type share four bytes, and the data follow at once
            size, kind = kind >> 16, kind & 0xFFFF
            found = self.data[self.at + 4 : self.at + 4 + size]
            self.at += 8
        else:
            found = self.data[self.at + 8 : self.at + 8 + size]
            self.at += 8 + size + (-size % 8 if kind != DEFLATED else 0)
        return kind, found


def matrix_head(parts: Elements) -> tuple[int, list[int], str]:
    """Class, shape and name of an array."""
    flags, shape, name = (parts.next()[1] for _ in range(3))
    return struct.unpack(f"{parts.order}I", flags[:4])[0] & 0xFF, np.frombuffer(shape, f"{parts.order}i4").tolist(), name.decode("latin-1")


def numbers(kind: int, data: bytes, order: str) -> np.ndarray:
    return np.frombuffer(data, np.dtype(NUMBERS[kind]).newbyteorder(order)).astype(np.float64)


def value_of(data: bytes, order: str) -> tuple[list[int], object]:
    """Shape and value of an array: numbers column by column, the rows of a text, the values of cells, the fields of a structure (a list of them where there are several)."""
    if not data:
        return [0, 0], np.empty(0)
    parts = Elements(data, order)
    kind, shape, _ = matrix_head(parts)
    total = int(np.prod(shape))
    if kind in NUMERIC:
        return shape, numbers(*parts.next(), order) if total else np.empty(0)
    if kind == CHAR:
        stored, text = parts.next() if total else (16, b"")
        code = TEXTS[stored] + ({"<": "-le", ">": "-be"}[order] if TEXTS[stored] in ("utf-16", "utf-32") else "")
        letters = text.decode(code)
        rows = shape[0]
        return shape, ["".join(letters[k::rows]) for k in range(rows)] if rows else []
    if kind == CELL:
        return shape, [value_of(parts.next()[1], order)[1] for _ in range(total)]
    if kind == STRUCT:
        width = struct.unpack(f"{order}i", parts.next()[1][:4])[0]
        names = parts.next()[1]
        fields = [names[k : k + width].partition(b"\0")[0].decode("latin-1") for k in range(0, len(names), width)]
        found = [{f: value_of(parts.next()[1], order) for f in fields} for _ in range(total)]
        return shape, found[0] if total == 1 else found
    raise ValueError(f"arrays of class {kind} cannot be read")


class ContainerFile:
    """The variables of an open file."""

    def __init__(self, file: pa.NativeFile, length: int):
        self.file, self.length, self.fetched = file, length, 0
        head = self.bytes(0, HEADER)
        self.order = {b"IM": "<", b"MI": ">"}.get(head[126:128], "")
        if not self.order:
            raise ValueError("not a container of level 5")

    def bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(max(0, min(n, self.length - at)))
        self.fetched += len(data)
        return data

    def variables(self, wanted: set[str]) -> dict[str, tuple[list[int], object]]:
        """Shapes and values of the wanted variables that the file has; it is read no further than to the last of them."""
        at, out = HEADER, {}
        while at + 8 <= self.length and len(out) < len(wanted):
            kind, size = struct.unpack(f"{self.order}II", self.bytes(at, 8))
            if kind == DEFLATED:
                name, rest = self.inflated(at + 8, size, wanted)
            elif kind == MATRIX:
                name = matrix_head(Elements(self.bytes(at + 8, min(size, HEAD)), self.order))[2]
                rest = self.bytes(at + 8, size) if name in wanted else b""
            else:
                name, rest = "", b""
            if name in wanted:
                out[name] = value_of(rest, self.order)
            at += 8 + size + (-size % 8 if kind != DEFLATED else 0)
        return out

    def inflated(self, at: int, size: int, wanted: set[str]) -> tuple[str, bytes]:
        """The name of a deflated variable, and its inflated array if it is wanted."""
        stream, end = zlib.decompressobj(), at + size
        data = self.bytes(at, min(size, 512))
        got = stream.decompress(data, HEAD)
        name = matrix_head(Elements(got[8:], self.order))[2]
        if name not in wanted:
            return name, b""
        parts, at = [got, stream.decompress(stream.unconsumed_tail)], at + len(data)
        while at < end:
            data = self.bytes(at, min(CHUNK, end - at))
            parts.append(stream.decompress(data))
            at += len(data)
        return name, b"".join(parts)[8:]


def reached(found: dict, path: str) -> tuple[list[int], object] | None:
    """Shape and value at a path of names; None where there is none."""
    head, *rest = path.split(".")
    at = found.get(head)
    for name in rest:
        if at is None or not isinstance(at[1], dict):
            return None
        at = at[1].get(name)
    return at


def as_column(at: tuple[list[int], object] | None, kind: str) -> object:
    """A value as one of a column's kind, or None where it is none of it; ``array<int>`` gives its shape."""
    if at is None:
        return None
    shape, value = at
    if kind == "array<int>":
        return shape
    if kind == "array<double>":
        return value if isinstance(value, np.ndarray) else None
    if kind == "double":
        return float(value[0]) if isinstance(value, np.ndarray) and len(value) == 1 else None
    texts = [x[0] if isinstance(x, list) and len(x) == 1 else "" if isinstance(x, np.ndarray | list) and not len(x) else x for x in value] if isinstance(value, list) else None
    if texts is None or not all(isinstance(x, str) for x in texts):
        return None
    return texts if kind == "array<string>" else texts[0] if len(texts) == 1 else "" if not texts else None


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.group = options["path"], options.get("pattern", "*.mat"), int(options.get("files", 4))
        self.columns = json.loads(options["columns"])

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path, self.pattern)
        return [Files(files[k : k + self.group]) for k in range(0, len(files), self.group)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        wanted = {path.split(".")[0] for path, _ in self.columns.values()}
        for path, length in partition.files:
            store, inner = opened(path)
            with store.open_input_file(inner) as file:
                found = ContainerFile(file, length).variables(wanted)
            values = [pa.array([as_column(reached(found, at), kind)], KINDS[kind]) for at, kind in self.columns.values()]
            yield pa.RecordBatch.from_arrays([pa.array([path]), *values], ["path", *self.columns])


def element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array_bytes(name: str, value: object) -> bytes:
    """The element of a number, a list of numbers (a row), a text, a list of texts (cells) or a dict (a structure)."""
    if value is None:
        value = []
    if isinstance(value, str):
        kind, shape, body = CHAR, [1 if value else 0, len(value.encode("utf-16-le")) // 2], element(4, value.encode("utf-16-le"))
    elif isinstance(value, dict):
        width = max(map(len, value), default=0) + 1
        names = b"".join(f.encode("latin-1").ljust(width, b"\0") for f in value)
        kind, shape, body = STRUCT, [1, 1], struct.pack("<HHi", 5, 4, width) + element(1, names) + b"".join(array_bytes("", v) for v in value.values())
    elif isinstance(value, list | tuple) and any(isinstance(x, str) for x in value):
        kind, shape, body = CELL, [1, len(value)], b"".join(array_bytes("", x) for x in value)
    else:
        row = np.atleast_1d(np.array([np.nan if x is None else x for x in value] if isinstance(value, list | tuple) else value, "<f8"))
        kind, shape, body = DOUBLE, [1, len(row)], element(9, row.tobytes())
    head = element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack("<ii", *shape)) + element(1, name.encode("latin-1"))
    return element(MATRIX, head + body)


def container_bytes(variables: dict[str, object], deflate: bool = True) -> bytes:
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    found = [array_bytes(k, v) for k, v in variables.items()]
    return head + b"".join(struct.pack("<II", DEFLATED, len(z)) + z for z in map(zlib.compress, found)) if deflate else head + b"".join(found)


class ContainerWriter(CommittedFiles):
    """Rows as files: the column ``file`` names it, the others are its variables."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, attempt = self.attempt(TaskContext.get())
        files: list[str] = []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    name = self.checked(row.pop("file"), files)
                    if not files:
                        store.create_dir(attempt, recursive=True)
                    files.append(name)
                    with store.open_output_stream(f"{attempt}/{name}") as out:
                        out.write(container_bytes(row))
        except BaseException:
            if files:
                store.delete_dir(attempt)
            raise
        return Written(files, attempt)


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return ", ".join(["path string", *(f"`{c}` {kind}" for c, (_, kind) in json.loads(self.options["columns"]).items())])

    def reader(self, schema: StructType) -> ContainerReader:
        return ContainerReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.dataSource.register(ContainerSource)
    return spark


def variables(spark: SparkSession, folder: str, columns: dict[str, tuple[str, str]], pattern: str = "*.mat") -> DataFrame:
    """(path, ...) with a column for each (path of names, kind) of ``columns``.

    Kinds are double, string, array<double> (column by column), array<string> (the rows
    of a text or the texts of cells) and array<int> (the shape). A variable that a file
    lacks, or that is of another kind, is NULL. Other variables are not inflated.
    """
    if unknown := {k for _, k in columns.values()} - set(KINDS):
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    return registered(spark).read.format("container").options(pattern=pattern, columns=json.dumps(columns)).load(folder)


def write_containers(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Each row as the file that its column ``file`` names, with its other columns as variables; all or none are committed."""
    registered(rows.sparkSession)
    rows.write.format("container").mode("overwrite" if overwrite else "append").save(folder)


def waveforms(spark: SparkSession, folder: str, wave: str = "signal", rate: str = "sampleRate", pattern: str = "*.signal") -> DataFrame:
    """(path, wave, rate) of sound files."""
    return variables(spark, folder, {"wave": (wave, "array<double>"), "rate": (rate, "double")}, pattern)
