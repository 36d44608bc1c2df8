"""Array kernels against numpy, and their properties."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.functions import arrays
from tracemill.functions.nulls import clean, first_of_largest, sem
from tracemill.operators import grids, traces

TRACES = st.lists(st.lists(st.floats(1, 100), min_size=8, max_size=8), min_size=3, max_size=6)
SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, f array<double>")


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


@SLOW
@given(rows=TRACES)
def test_dff_and_peak(spark, rows):
    df = frame(spark, rows).withColumn("d", arrays.dff(F.col("f"), 2, 4)).withColumn("p", arrays.peak(F.col("f"), 3, 4, 2.0))
    for x, d, p in zip(np.array(rows), values(df, "d"), values(df, "p"), strict=True):
        f0 = x[1:4].mean()
        assert d == pytest.approx((x[1:] - f0) / f0)
        window, base = x[2:6], x[:3]
        assert p.pk == window.max() and p.idx == window.argmax() + 1
        assert p.threshold == pytest.approx(base.mean() + 2 * base.std(ddof=1))
        assert p.sig == (p.pk >= p.threshold) and p.sig_pk == (p.pk if p.sig else None)


@SLOW
@given(rows=TRACES, factor=st.floats(0.5, 20))
def test_dff_does_not_see_scale(spark, rows, factor):
    df = frame(spark, rows).select("id", arrays.dff(F.col("f"), 1, 3).alias("a"), arrays.dff(F.transform("f", lambda v: v * factor), 1, 3).alias("b"))
    for a, b in zip(values(df, "a"), values(df, "b"), strict=True):
        assert a == pytest.approx(b, abs=1e-9)


@SLOW
@given(rows=TRACES)
def test_long_and_array_paths_agree(spark, rows):
    df = frame(spark, rows)
    long = traces.exploded(df, ["id"], "f")
    a = traces.peaks(long, ["id"], "f", 3, 4).orderBy("id").collect()
    b = values(df.withColumn("p", arrays.peak(F.col("f"), 3, 4)), "p")
    for x, y in zip(a, b, strict=True):
        assert (x.pk, x.idx, x.sig) == (y.pk, y.idx, y.sig) and x.threshold == pytest.approx(y.threshold)
    c = traces.relative_change(long, ["id"], 1, 3).orderBy("id", "frame").collect()
    d = values(df.withColumn("d", arrays.dff(F.col("f"), 1, 3)), "d")
    assert [r.dff for r in c] == pytest.approx([v for row in d for v in row])


@SLOW
@given(rows=TRACES)
def test_averaging_commutes_with_additive_baseline(spark, rows):
    df = frame(spark, rows)
    first = traces.exploded(df.select("id", arrays.less_mean(F.col("f"), 2, 3).alias("f")), ["id"], "f").groupBy("frame").agg(F.avg("f").alias("f"))
    got = [r.f for r in first.orderBy("frame").collect()]
    mean = np.array(rows).mean(axis=0)
    assert got == pytest.approx(mean - mean[1:4].mean(), abs=1e-9)


def test_missing_values(spark):
    df = frame(spark, [[1.0, None, 3.0, 4.0], [0.0, 0.0, 5.0, 6.0], [2.0, 2.0, None, 4.0], [5.0]])
    d = values(df.withColumn("d", arrays.dff(F.col("f"), 1, 2)), "d")
    assert d[0] == [None] * 4  # a baseline frame is missing
    assert d[1] == [None] * 4  # a baseline of 0
    assert d[2] == [0.0, 0.0, None, 1.0]
    assert values(df.withColumn("m", arrays.mean_of(F.col("f"))), "m") == pytest.approx([8 / 3, 2.75, 8 / 3, 5.0])
    assert values(df.withColumn("s", arrays.sample_std(F.col("f"))), "s")[3] == 0.0


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, None), ("c", 1, 4.0), ("d", 1, float("nan"))], "k string, i int, v double").withColumn("v", clean(F.col("v")))
    got = {r.k: (r.s, r.i) for r in df.groupBy("k").agg(sem(F.col("v")).alias("s"), first_of_largest(F.col("v"), F.col("i")).alias("i")).collect()}
    assert got["a"][0] == pytest.approx(1.0) and got["a"][1] == 2  # first on ties
    assert got["b"] == (None, None) and got["d"] == (None, None)
    assert got["c"] == (0.0, 1)


def test_runs_segments_and_index(spark):
    df = frame(spark, [[1.0, -1.0, 1.0, 1.0, 1.0, -1.0, 1.0, 1.0]])
    up = F.transform("f", lambda v: v > 0)
    r = df.select(arrays.longest_run(up).alias("run"), arrays.first_frame(F.transform("f", lambda v: v < 0)).alias("first"), arrays.segments(F.col("f"), 2, 3, 2).alias("seg"), arrays.linear_index(F.lit(2), F.lit(3), 4).alias("at"), arrays.octaves(F.lit(2.0), F.lit(8.0)).alias("oct")).first()
    assert (r.run, r.first, r["at"], r.oct) == (3, 2, 10, 2.0)
    assert r.seg == [[1.0, 1.0, 1.0], [-1.0, 1.0, 1.0]]
    assert df.select(arrays.longest_run(F.transform("f", lambda v: v > 9)).alias("x")).first().x == 0


def test_onsets_align(spark):
    df = spark.createDataFrame([(1, 3, [1.0, 2.0, 9.0, 4.0, 5.0, 6.0]), (2, 4, [0.0, 1.0, 2.0, 9.0, 4.0, 5.0])], "id int, onset int, f array<double>")
    got = [r[0] for r in df.orderBy("id").select(arrays.onset_aligned(F.col("f"), F.col("onset"), F.lit(3), F.lit(4))).collect()]
    assert got == [[1.0, 2.0, 9.0, 4.0, 5.0], [1.0, 2.0, 9.0, 4.0, 5.0]]


def levels(spark, sig):
    rows = [(cell, db, 1.0 * db, s) for cell, flags in sig.items() for db, s in enumerate(flags) if s is not None]
    return spark.createDataFrame(rows, "cell string, db int, pk double, sig boolean")


def test_runs_of_levels(spark):
    t = levels(spark, {"three": [False, True, True, True, False], "two": [True, True, False, True, True], "gap": [True, True, None, True, False], "none": [False] * 5})
    curves = grids.level_functions(t, ["cell"])
    assert curves.count() == 20  # a level that a cell lacks is there and breaks its run
    got = {r.cell: (r.included, r.threshold, r.n_sig) for r in grids.responsive_cells(curves, ["cell"]).collect()}
    assert got == {"three": (True, 1, 3), "two": (False, None, 4), "gap": (False, None, 3), "none": (False, None, 0)}


def test_duplicate_levels_are_averaged(spark):
    t = spark.createDataFrame([("a", 1, 2.0, False), ("a", 1, 4.0, True)], "cell string, db int, pk double, sig boolean")
    assert [tuple(r) for r in grids.level_functions(t, ["cell"]).collect()] == [("a", 1, 3.0, True)]


def test_grid_corner_ties_and_silence(spark):
    rows = [("c", d, f, 9.0 if (d, f) == (1, 1) else 1.0, True) for d in (1, 2) for f in (1, 2, 3)] + [("z", 1, 5, 1.0, False), ("z", 1, 4, 1.0, False)]
    grid = grids.response_grid(spark.createDataFrame(rows, "cell string, db int, freq int, pk double, sig boolean"), ["cell"], squared=False)
    bf = {r.cell: r.bf for r in grids.best_frequency(grid, ["cell"]).collect()}
    assert bf == {"c": 1, "z": 4}  # the lowest frequency where nothing responds
    d = {r.cell: r.dprime for r in grids.selectivity(grid, ["cell"]).collect()}
    assert d["c"] == pytest.approx((9 + 1 + 1) / 3 - 14 / 6) and d["z"] is None
