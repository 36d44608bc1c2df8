"""Stacks read in ranges and streamed to files."""

from __future__ import annotations

import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.sources import stacks


def frames_of(spark, files: int = 3, each: int = 20):
    px = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda x: (x * F.col("id") - 100).cast("short"))
    return spark.range(files * each).select(F.concat(F.lit("f"), F.col("id") % files, F.lit(".tif")).alias("file"), F.floor(F.col("id") / files).alias("k"), F.lit(4).alias("h"), F.lit(5).alias("w"), px.alias("px"))


@pytest.mark.parametrize("wide", [False, True])
def test_streams_are_read_in_ranges(spark, tmp_path, wide, monkeypatch):
    if wide:
        monkeypatch.setattr(stacks, "CLASSIC", 0)
    given = frames_of(spark).repartition(5)
    stacks.write_stacks(given, str(tmp_path), "file", "k", note=F.concat(F.lit("of "), F.col("file")))
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["f0.tif", "f1.tif", "f2.tif"]
    assert (tmp_path / "f0.tif").read_bytes()[2] == (43 if wide else 42)
    want = {(r.file, r.k + 1): r.px for r in given.collect()}
    for split in (100, 700, 1 << 30):
        read = stacks.stacks(spark, str(tmp_path), split=split)
        got = [((r.path.rsplit("/", 1)[1], r.image), r.px, r.h, r.w) for r in read.collect()]
        assert len(got) == len(want) and all(want[k] == px and (h, w) == (4, 5) for k, px, h, w in got)
    assert {(r.path[-6:], r.copyright, r.bits) for r in stacks.stacks(spark, f"file:{tmp_path}", "headers").collect()} == {(f"f{k}.tif", f"of f{k}.tif", 16) for k in range(3)}


def test_whole_files_from_other_stores(spark, tmp_path, monkeypatch):
    stacks.write_stacks(frames_of(spark), str(tmp_path), "file", "k")
    ranged = {what: sorted(map(str, stacks.stacks(spark, str(tmp_path), what).drop("path").collect())) for what in ("frames", "headers", "counts")}

    def unknown(path):
        raise pa.ArrowInvalid("a store of which pyarrow knows nothing")

    monkeypatch.setattr(stacks, "opened", unknown)
    for what, want in ranged.items():
        assert sorted(map(str, stacks.stacks(spark, str(tmp_path), what).drop("path").collect())) == want


def test_sparse_file_of_three_gib(spark, tmp_path):
    """64-bit offsets, two images 3 GiB apart: each is fetched by the partition that has its directory, and a header reads no more for the length."""
    h, w, far = 3, 4, 3 << 30
    first, second = (np.arange(h * w).reshape(h, w) + k for k in (0, 100))
    one, _ = stacks.directory_bytes(16, (h, w), {stacks.SOFTWARE: b"SI.a = 1\0"}, True, False)
    n = struct.unpack_from("<Q", one)[0]
    one = one[: 8 + 20 * n] + struct.pack("<Q", far) + one[16 + 20 * n :]  # the next directory lies far behind
    two, _ = stacks.directory_bytes(far, (h, w), {}, True, True)
    with open(tmp_path / "big.tif", "wb") as out:
        out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + one + first.astype("<i2").tobytes())
        out.seek(far)
        out.write(two + second.astype("<i2").tobytes())
    read = stacks.stacks(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() == 13
    assert {r.image: r.px for r in read.collect()} == {1: first.ravel().tolist(), 2: second.ravel().tolist()}
    assert stacks.stacks(spark, str(tmp_path), "counts").first().images == 2
    assert stacks.stacks(spark, str(tmp_path), "headers").first().software == "SI.a = 1"


def test_headers_read_as_much_for_any_number_of_frames(tmp_path):
    read = []
    for n in (2, 2000):
        path = tmp_path / f"{n}.tif"
        with open(path, "wb") as out:
            stream = stacks.StackStream(pa.PythonFile(out, "w"), False)
            for k in range(n):
                stream.add(np.full((8, 8), k), {stacks.SOFTWARE: b"SI.a = 1\0"})
            stream.flush(last=True)
        with pa.OSFile(str(path)) as file:
            stack = stacks.StackFile(file, path.stat().st_size)
            assert stacks.header_of(stack)[4] == "SI.a = 1"
            read.append(stack.fetched)
    assert read[0] == read[1] < 1024


def test_streams_hold_two_frames_at_most(tmp_path):
    image = np.zeros((256, 256), np.int16)
    with pa.OSFile(str(tmp_path / "a.tif"), "wb") as out:
        stream = stacks.StackStream(out, False)
        tracemalloc.start()
        for _ in range(200):
            stream.add(image, {})
        stream.flush(last=True)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert (tmp_path / "a.tif").stat().st_size > 200 * image.nbytes and peak < 8 * image.nbytes


def test_failed_writes_leave_nothing(spark, tmp_path):
    """A task that fails in the middle, a file that is there already, and one that two tasks write."""
    broken = F.when(F.col("k") == 15, F.raise_error(F.lit("lost"))).otherwise(F.lit(4)).cast("int")
    with pytest.raises(Exception, match="lost"):
        frames_of(spark).withColumn("h", broken).repartition("file").sortWithinPartitions("file", "k").withColumn("note", F.lit(None).cast("string")).select("file", "h", "w", "px", "note").write.format("stack").mode("append").save(str(tmp_path / "a"))
    assert not (tmp_path / "a").exists() or list((tmp_path / "a").iterdir()) == []
    stacks.write_stacks(frames_of(spark), str(tmp_path / "b"), "file", "k")
    before = {x.name: x.read_bytes() for x in (tmp_path / "b").iterdir()}
    with pytest.raises(Exception, match="written twice"):
        stacks.write_stacks(frames_of(spark, 4), str(tmp_path / "b"), "file", "k")
    assert {x.name: x.read_bytes() for x in (tmp_path / "b").iterdir()} == before
    stacks.write_stacks(frames_of(spark, 3, 5), str(tmp_path / "b"), "file", "k", overwrite=True)
    assert {r.images for r in stacks.stacks(spark, str(tmp_path / "b"), "counts").collect()} == {5}
    with pytest.raises(Exception, match="written twice"):
        frames_of(spark, 1).repartition(2).withColumn("note", F.lit(None).cast("string")).select("file", "h", "w", "px", "note").write.format("stack").mode("append").save(str(tmp_path / "c"))
    assert list((tmp_path / "c").iterdir()) == []


def test_rings_and_other_files_are_errors(tmp_path):
    ring = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<HHHIII", 1, 256, 4, 1, 1, 8)
    (tmp_path / "ring.tif").write_bytes(ring)
    with pa.OSFile(str(tmp_path / "ring.tif")) as file, pytest.raises(ValueError, match="ring"):
        list(stacks.StackFile(file, len(ring)).chain())
    with pytest.raises(ValueError, match="not a TIFF"):
        stacks.StackFile(pa.BufferReader(b"no stack at all, this one"), 25)
