"""Variables read out of containers, and only those."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracemill.sources import containers, movies


def test_values_of_all_kinds(spark, tmp_path):
    first = {"x": [1.5, 2.0, None], "one": 3, "text": "Zoë", "names": ["a.tif", "", "bc.tif"], "params": {"stimDelay": 0.5, "pulse": {"name": "p_1"}}, "empty": [], "nothing": ""}
    (tmp_path / "a.mat").write_bytes(containers.container_bytes(first))
    (tmp_path / "b.mat").write_bytes(containers.container_bytes({"x": [7.0], "params": 4}, deflate=False))
    (tmp_path / "notes.txt").write_text("x")
    columns = {"x": ("x", "array<double>"), "shape": ("x", "array<int>"), "one": ("one", "double"), "text": ("text", "string"), "names": ("names", "array<string>"), "delay": ("params.stimDelay", "double"), "pulse": ("params.pulse.name", "string"), "wrong": ("text", "double"), "many": ("x", "double"), "empty": ("empty", "array<double>"), "nothing": ("nothing", "string")}
    a, b = sorted(containers.variables(spark, str(tmp_path), columns).collect(), key=lambda r: r.path)
    assert a.x[:2] == [1.5, 2.0] and np.isnan(a.x[2]) and a.shape == [1, 3]
    assert tuple(a[3:]) == (3.0, "Zoë", ["a.tif", "", "bc.tif"], 0.5, "p_1", None, None, [], "")
    assert (b.x, b.many, b.one, b.text, b.delay) == ([7.0], 7.0, None, None, None)
    with pytest.raises(ValueError, match="unknown kinds"):
        containers.variables(spark, str(tmp_path), {"x": ("x", "map")})


def test_matrices_of_other_writers(tmp_path):
    """Big-endian, numbers stored as bytes, short elements, rows of a text, and a structure array."""

    def element(kind, data):
        return struct.pack(">II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def short(kind, data):
        return struct.pack(">HH", len(data), kind) + data.ljust(4, b"\0")

    def array(kind, shape, name, body):
        return element(14, element(6, struct.pack(">II", kind, 0)) + element(5, struct.pack(f">{len(shape)}i", *shape)) + (short if len(name) <= 4 else element)(1, name) + body)

    numbers = array(6, (2, 3), b"m", element(2, bytes([1, 2, 3, 4, 5, 6])))
    text = array(4, (2, 3), b"t", element(4, "acbdef".encode("utf-16-be")))
    field = array(6, (1, 1), b"", short(3, struct.pack(">h", -2)))
    several = array(2, (1, 2), b"s", short(5, struct.pack(">i", 2)) + short(1, b"v\0") + field + field)
    data = b"x".ljust(124) + struct.pack(">H", 0x0100) + b"MI" + numbers + struct.pack(">II", 15, len(z := zlib.compress(text))) + z + several
    found = containers.ContainerFile(pa.BufferReader(data), len(data)).variables({"m", "t", "s"})
    assert found["m"][0] == [2, 3] and found["m"][1].tolist() == [1, 2, 3, 4, 5, 6]
    assert found["t"][1] == ["abe", "cdf"] and [x["v"][1].tolist() for x in found["s"][1]] == [[-2.0], [-2.0]]
    with pytest.raises(ValueError, match="level 5"):
        containers.ContainerFile(pa.BufferReader(b"\x89HDF" + b"\0" * 200), 204)


def test_other_variables_are_passed_over(tmp_path):
    rng = np.random.default_rng(0)
    large = rng.normal(size=200_000).tolist()
    data = containers.container_bytes({"large": large, "small": 1.0, "later": large})
    file = containers.ContainerFile(pa.BufferReader(data), len(data))
    assert file.variables({"small"})["small"][1].tolist() == [1.0]
    assert len(data) > 1_000_000 and file.fetched < 4096


def test_saved_rows_are_loaded_again(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{k}.mat", [float(k), 2.0], f"n{k}", (0.5, ["x", "y"])) for k in range(9)], "file string, f array<double>, name string, p struct<d:double, t:array<string>>").repartition(3)
    containers.write_containers(rows, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 9
    got = containers.variables(spark, str(tmp_path / "out"), {"f": ("f", "array<double>"), "name": ("name", "string"), "d": ("p.d", "double"), "t": ("p.t", "array<string>")}).collect()
    assert sorted((r.name, r.f, r.d, r.t) for r in got) == [(f"n{k}", [float(k), 2.0], 0.5, ["x", "y"]) for k in range(9)]
    with pytest.raises(Exception, match="written twice"):
        containers.write_containers(rows, str(tmp_path / "out"))


def test_waveforms_are_loaded_and_cut(spark, tmp_path):
    (tmp_path / "tone.signal").write_bytes(containers.container_bytes({"signal": [0.0, 1.0, 2.0, 3.0], "sampleRate": 2.0, "other": "x"}))
    wave = containers.waveforms(spark, str(tmp_path))
    cut = wave.select(movies.waveform_window(wave["wave"], wave["rate"], 0.5, 1.0)).first()[0]
    assert [tuple(x) for x in cut] == [(0.5, 1.0), (1.0, 2.0)]
