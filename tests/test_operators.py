"""Relations, regions, statistics, sources and the stream, on small tables worked out by hand."""

from __future__ import annotations

import json
import math
import struct
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.functions import distributions, stimnames
from tracemill.operators import alignment, relations, roi
from tracemill.operators import statistics as st
from tracemill.sources import stacks, tables, tiff
from tracemill.streaming import online


def test_missing_partner_is_an_error(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(relations.MissingKey, match="2"):
        relations.require_partners(a, b, ["k"])
    assert relations.require_partners(b, a, ["k"]).count() == 1


def test_frames_are_located_at_range_ends(spark):
    rec = spark.createDataFrame([("g", 1, 3), ("g", 2, 2), ("h", 3, 4)], "g string, tif int, n int")
    ranges = relations.frame_ranges(rec, ["g"], ["tif"], "n")
    frames = spark.createDataFrame([("g", f) for f in range(1, 8)] + [("h", 4), ("x", 1)], "g string, frame int")
    got = sorted(tuple(r) for r in relations.located(frames, ranges, ["g"], "frame", ["tif"]).collect())
    assert got == [("g", 1, 1, 1), ("g", 2, 1, 2), ("g", 3, 1, 3), ("g", 4, 2, 1), ("g", 5, 2, 2), ("h", 4, 3, 4)]


def test_keys_skip_nulls_and_sets_contain(spark):
    rows = spark.createDataFrame([("b", 5), ("a", 7), ("a", 3), (None, 1), ("a", None)], "animal string, roi int")
    got = sorted((r.animal, r.roi, r.outer_no, r.inner_no) for r in relations.dense_keys(rows, "animal", "roi").collect())
    assert got == [("a", 3, 1, 1), ("a", 7, 1, 2), ("b", 5, 2, 1)]
    groups = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "grp int, m string")
    sets = spark.createDataFrame([("s", "x"), ("s", "y"), ("t", "x"), ("t", "x")], "sid string, m string")
    assert [tuple(r) for r in relations.containing_sets(groups, sets, "grp", "sid", "m").collect()] == [(1, "s")]


def test_treatments_fall_pre_before_post(spark):
    rows = spark.createDataFrame([("postX", 1), ("preX", 2), ("preX", 1), ("preX", 1)], "treatment string, level int")
    got = [tuple(r) for r in relations.ordered_stimuli(rows, ["treatment", "level"]).orderBy("stim_id").collect()]
    assert got == [("preX", 2, 1), ("preX", 1, 2), ("postX", 1, 3)]


def test_crop_keeps_whole_regions(spark):
    px = spark.createDataFrame([("in", 66, 3), ("in", 67, 3), ("over", 64, 1), ("over", 65, 1), ("out", 10, 1)], "roi string, row int, col int")
    assert sorted(tuple(r) for r in roi.cropped(px, ["roi"], 65, 192).collect()) == [("in", 2, 3), ("in", 3, 3)]


def test_ring_closes(spark):
    px = spark.createDataFrame([("a", r, c) for r in (1, 2, 3) for c in (1, 2, 3)], "roi string, row int, col int")
    edge = roi.outline(px, ["roi"])
    assert edge.count() == 8  # the middle pixel is not on the outline
    ring = roi.on_curve(edge, ["roi"]).first().ring.split(" ")
    assert ring[0] == ring[-1] and len(set(ring)) == 8


def test_deleted_mask_keeps_its_row(spark):
    frames = spark.createDataFrame([(1, "r", [1.0, 2.0, 3.0, 4.0]), (1, "d", [1.0, 2.0, 3.0, 4.0])], "frame int, roi string, px array<double>")
    masks = spark.createDataFrame([("r", 1, 2, False), ("r", 2, 1, False), ("d", 1, 1, True)], "roi string, row int, col int, deleted boolean")
    got = {r.roi: r.f for r in roi.masked_means(frames, masks, ["frame"], ["roi"], 2).collect()}
    assert got == {"r": 2.5, "d": None}


def test_names(spark):
    names = [("BPN_5-10kHz_x_50dB_x_100msPulse_500msTotal_1sOnset",), ("none",)]
    df = spark.createDataFrame(names, "name string")
    r = df.select(*[v.alias(k) for k, v in stimnames.noise_burst(F.col("name")).items()]).collect()
    assert tuple(r[0]) == (1.0, 50.0, 100.0, 500.0, "5-10") and tuple(r[1]) == (None,) * 5
    tone = spark.createDataFrame([("25msDRC_5-52kHz_50-60dB_8s_stim_10000Hz_70dB_400ms_at_0pt5s_2",)], "name string")
    t = tone.select(*[v.alias(k) for k, v in (stimnames.pure_tone(F.col("name")) | {"delta": stimnames.noise_contrast(F.col("name"))["delta_db"]}).items()]).first()
    assert tuple(t) == (10000.0, 70.0, 0.5, 400.0, 10.0)
    families = spark.createDataFrame([("x PTinContrast BPN",), ("BPN",), ("none",)], "s string")
    assert [r[0] for r in families.select(stimnames.family(F.col("s"))).collect()] == ["CGC", "BPN", None]


def test_p_values(spark):
    """Tabled points of Student's t, odd and even degrees of freedom, and the far end of the series; missing and no freedom."""
    points = [(12.706205, 1, 0.05), (4.302653, 2, 0.05), (3.182446, 3, 0.05), (2.228139, 10, 0.05), (63.656741, 1, 0.01), (3.169273, 10, 0.01), (1.960201, 10_000, 0.05), (1.960201, 10_001, 0.05), (0.0, 5, 1.0), (-2.228139, 10, 0.05), (None, 5, None), (1.0, 0, None)]
    found = spark.createDataFrame([(float(t) if t is not None else None, n) for t, n, _ in points], "t double, df long").select("*", distributions.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    want = {(t, n): p for t, n, p in points}
    assert all((r.p is None and want[r.t, r.df] is None) or r.p == pytest.approx(want[r.t, r.df], abs=2e-7) for r in found)
    assert spark.range(1).select(distributions.normal_two_sided(F.lit(1.959964))).first()[0] == pytest.approx(0.05, abs=1e-6)
    back = spark.createDataFrame([(1,), (2,), (10,), (60,), (20_000,)], "df long").select(distributions.t_quantile(0.95, F.col("df"), st.Z95)).collect()
    assert [r[0] for r in back] == pytest.approx([12.706205, 4.302653, 2.228139, 2.000298, 1.960083], abs=2e-6)


def test_counted_permutations(spark):
    """Against all subsets one by one; a key too large for its table is tested by draws."""
    from itertools import combinations

    rng = np.random.default_rng(3)
    rows = [(g, float(x), bool(k < m), f"{g}{k}") for g, n, m in (("a", 9, 4), ("b", 8, 6), ("c", 5, 0)) for k, x in enumerate(rng.integers(-5, 30, n))]
    df = spark.createDataFrame(rows, "g string, x double, first boolean, id string")
    found = {r.g: r for r in st.counted_permutation_test(df, ["g"], "x", F.col("first"), 1.0, "id").collect()}
    assert set(found) == {"a", "b"}
    for g in found:
        xs, m = [r[1] for r in rows if r[0] == g], sum(r[2] for r in rows if r[0] == g)
        gap = lambda s, xs=xs, m=m: s / m - (sum(xs) - s) / (len(xs) - m)
        given = gap(sum(xs[:m]))
        every = [abs(gap(sum(c))) >= abs(given) - 1e-9 for c in combinations(xs, m)]
        assert found[g].p == pytest.approx(sum(every) / len(every)) and found[g].difference == pytest.approx(given) and found[g].n == len(xs)
    drawn = {r.g: r.p for r in st.counted_permutation_test(df, ["g"], "x", F.col("first"), 1.0, "id", cells=1, rounds=400).collect()}
    assert set(drawn) == {"a", "b"} and all(abs(drawn[g] - found[g].p) < 0.12 for g in drawn)


def test_exact_permutations_tie_whatever_the_order(spark):
    """Samples whose sums depend on the order of the rows: the given one ties with itself, equal ones with each other."""
    from itertools import combinations

    cents = [44_170_911, 9_216_707, 21_555_503, 49_999_999, 30_000_001, 44_170_911, 12_345_679, 47_000_013, 33_333_337]
    rows = [(g, (c + g) / 100, k % 5 != 1) for g in range(200) for k, c in enumerate(cents)]
    rng = np.random.default_rng(0)
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(g), float(x), bool(f)) for g, x, f in rows], "g int, x double, first boolean").repartition(7)
    found = {r.g: r for r in st.exact_permutation_test(df, ["g"], "x", F.col("first"), 10, 0.01).collect()}
    n, m = len(cents), sum(k % 5 != 1 for k in range(len(cents)))
    for g in range(200):
        xs = [c + g for c in cents]
        gap = lambda s, xs=xs: abs(s * n - sum(xs) * m)
        given = gap(sum(x for k, x in enumerate(xs) if k % 5 != 1))
        every = [gap(sum(c)) >= given for c in combinations(xs, m)]
        assert found[g].p == sum(every) / len(every)


def test_draws_by_limits(spark):
    """Poisson numbers by comparing digits against the sums of chances; a rate of 0, small, large and one at which all draws pass."""
    from tracemill.operators import grids

    rng = np.random.default_rng(2)
    rows = [(float(rate), f"{int(h):012x}") for rate in (0.0, 1e-20, 0.05, 1.0, 5.0) for h in (0, 16**12 - 1, *rng.integers(0, 16**12, 200))]
    df = spark.createDataFrame(rows, "rate double, share string").withColumn("limits", grids.draw_limits(F.col("rate")))
    for r in df.withColumn("times", grids.drawn_times(F.col("share"), F.col("limits"))).collect():
        chances = np.cumsum([math.exp(-r.rate) * r.rate**k / math.factorial(k) for k in range(7)])
        assert r.times == sum(int(r.share, 16) / 16**12 >= c for c in chances)


def test_sums_by_transform():
    """Against the table of all sizes and sums: smooth, two-valued, even but for one, and far outlying scores; and a sample too large for the table."""
    rng = np.random.default_rng(11)
    for scores, size in ((rng.integers(0, 111, 900), 70), (rng.integers(0, 2, 300) * 7, 100), (np.append(rng.integers(0, 20, 400) * 2, 3), 90), (np.append(rng.integers(0, 5, 500), 400), 250), (rng.integers(0, 30, 130), 65), (np.zeros(200, int), 80)):
        scores = scores - scores.min()
        want = st.sum_distribution(scores, size)
        got, start = st.transformed_distribution(*np.unique(scores, return_counts=True), size)
        inside = want[start : start + len(got)]
        assert np.abs(got[: len(inside)] - inside).max() < 1e-12 and want.sum() - inside.sum() < 1e-12 and abs(got.sum() - 1) < 1e-10
    many, start = st.transformed_distribution(np.arange(111), np.full(111, 2000), 14_000)
    sums = start + np.arange(len(many))
    mean, p = float((sums * many).sum()), 14_000 / 222_000
    assert mean == pytest.approx(55 * 14_000) and float(((sums - mean) ** 2 * many).sum()) == pytest.approx(14_000 * (1 - p) * (111**2 - 1) / 12 * 222_000 / 221_999)


def test_draws_exchange_edges_only(spark):
    """A round's draw against the plain order by hash, and what the plan exchanges: blocks of rounds, not every draw."""
    import hashlib

    rng = np.random.default_rng(5)
    rows = [(g, float(x), bool(k < m), f"{g}{k}") for g, n, m in (("a", 300, 40), ("b", 7, 6), ("c", 5, 5)) for k, x in enumerate(rng.normal(0, 10, n))]
    df = spark.createDataFrame(rows, "g string, x double, first boolean, id string")
    found = {r.g: r for r in st.permutation_test(df, ["g"], "x", F.col("first"), "id", 45, block=10).collect()}
    assert set(found) == {"a", "b"}
    for g in found:
        own = [r for r in rows if r[0] == g]
        n, m, total = len(own), sum(r[2] for r in own), sum(r[1] for r in own)
        gap = lambda s, n=n, m=m, total=total: s / m - (total - s) / (n - m)
        given = gap(sum(r[1] for r in own if r[2]))
        order = lambda r, k: (hashlib.md5(f"{r[3]}:{k}".encode()).hexdigest()[:15], r[3])
        draws = [gap(sum(r[1] for r in sorted(own, key=lambda r, k=k: order(r, k))[:m])) for k in range(1, 46)]
        assert found[g].p == pytest.approx((sum(abs(d) >= abs(given) - 1e-9 for d in draws) + 1) / 46) and found[g].difference == pytest.approx(given)


def test_draws_send_nothing_through_the_driver(spark, sf):
    """Parquet's sizes made the rows, once for each block of rounds, the side to broadcast."""
    from tracemill.jobs import catalog

    found = catalog.queries()["perm_draws"](spark, sf)
    assert found.count() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_draws_far_from_the_size_are_summed(spark):
    """Draws below, near and above the expected hash; rows that share their hashes or have none, of which the size is reached elsewhere."""
    import hashlib

    rng = np.random.default_rng(6)
    ids = {"all": str, "few": lambda k: str(k // 100), "one": lambda k: "same", "none": lambda k: None if k % 2 else str(k)}
    rows = [(g, float(x), bool(k < m), ids[g](k)) for g, n, m in (("all", 2000, 900), ("few", 400, 150), ("one", 300, 200), ("none", 600, 400)) for k, x in enumerate(rng.normal(0, 10, n))]
    df = spark.createDataFrame(rows, "g string, x double, first boolean, id string").repartition(5)
    low, high = spark.range(1).select(*st.near_limits(F.lit(2000), F.lit(900))).first()
    assert 0.3 < int(low, 16) / 16**15 < 0.45 < int(high, 16) / 16**15 < 0.6
    found = {r.g: r for r in st.permutation_test(df, ["g"], "x", F.col("first"), "id", 25, block=4).collect()}
    for g in ids:
        own = [r for r in rows if r[0] == g]
        n, m, total = len(own), sum(r[2] for r in own), sum(r[1] for r in own)
        gap = lambda s, n=n, m=m, total=total: s / m - (total - s) / (n - m)
        given = gap(sum(r[1] for r in own if r[2]))
        order = lambda r, k: (hashlib.md5(f"{r[3]}:{k}".encode()).hexdigest()[:15], r[3], r[1]) if r[3] else ("g", "", r[1])
        draws = [gap(sum(r[1] for r in sorted(own, key=lambda r, k=k: order(r, k))[:m])) for k in range(1, 26)]
        assert found[g].n == n and found[g].p == pytest.approx((sum(abs(d) >= abs(given) - 1e-9 for d in draws) + 1) / 26) and found[g].difference == pytest.approx(given)


def test_statistics(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, 40), rng.normal(2, 1, 30)
    rows = spark.createDataFrame([("g", float(x), True) for x in a] + [("g", float(x), False) for x in b], "g string, x double, first boolean")
    r = st.two_sample_t(rows, ["g"], F.col("x"), F.col("first")).first()
    pooled = math.sqrt(((39 * a.var(ddof=1)) + 29 * b.var(ddof=1)) / 68 * (1 / 40 + 1 / 30))
    assert r.t == pytest.approx((a.mean() - b.mean()) / pooled) and r.df == 68
    found = st.significant_difference(rows, ["g"], "x", F.col("first")).first()
    assert found.sig and 0 <= found.p < 1e-4
    numbered = rows.withColumn("id", F.xxhash64("x"))
    assert st.permutation_test(numbered, ["g"], "x", F.col("first"), "id", 100).first().p < 0.05
    few = spark.createDataFrame([("g", v, f) for v, f in [(1.0, True), (2.0, True), (3.0, False), (4.0, False)]], "g string, x double, first boolean")
    assert st.exact_permutation_test(few, ["g"], "x", F.col("first")).first().p == pytest.approx(2 / 6)
    shifted = st.significant_shift(rows.where("NOT first"), ["g"], "x").first()
    assert shifted.sig and shifted.p < 1e-4 and st.significant_shift(rows.where("NOT first"), ["g"], "x", 2.0).first().p > 0.01
    exact = st.quantiles(rows, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 1.0}).first()
    assert (exact.a, exact.b, exact.c) == pytest.approx(tuple(np.quantile(np.concatenate([a, b]), [0.1, 0.5, 1.0])))
    cdf = [r[0] for r in spark.createDataFrame([(x,) for x in (-6.0, -1.0, 0.0, 1.959964, 5.0)], "z double").select(st.normal_cdf(F.col("z"))).collect()]
    assert cdf == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in (-6.0, -1.0, 0.0, 1.959964, 5.0)], rel=2e-7)
    ties = spark.createDataFrame([("g", v, f) for v, f in [(1.0, True), (2.0, True), (2.0, False), (3.0, False)]], "g string, x double, first boolean")
    assert st.rank_sum(ties, ["g"], "x", F.col("first")).first().w == 1 + 2.5
    signed = spark.createDataFrame([("g", d) for d in (1.0, -1.0, 2.0, 0.0)], "g string, d double")
    w = st.signed_rank(signed, ["g"], "d").first()
    assert (w.n, w.w) == (3, 1.5 + 3)


def test_normality(spark):
    rng = np.random.default_rng(1)
    rows = [("n", float(x)) for x in rng.normal(5, 2, 200)] + [("e", float(x)) for x in rng.exponential(1, 200)]
    got = {r.g: r.a2 for r in st.anderson_darling(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert got["n"] < 0.752 < got["e"]


def test_pulses_and_repetitions(spark):
    rec = spark.createDataFrame([("t1", ["a", "b"], [1, 2]), ("t2", ["a"], [1])], "tif string, stim array<string>, k array<int>")
    pulses = alignment.pulses_of(rec, ["tif"], ["stim", "k"])
    assert sorted(tuple(r) for r in pulses.collect()) == [("t1", 1, "a", 1), ("t1", 2, "b", 2), ("t2", 1, "a", 1)]
    traces = spark.createDataFrame([("t1", "r", [0.0, 1.0, 2.0, 3.0, 4.0]), ("t2", "r", [0.0, 5.0, 6.0])], "tif string, roi string, f array<double>")
    cut = alignment.pulse_traces(traces, pulses, ["tif"], "f", 1, 2)
    got = sorted((r.tif, r.stim, r.rep, r.f) for r in alignment.repetitions(cut, ["roi"], ["stim"], ["tif"]).collect())
    assert got == [("t1", "a", 1, [1.0, 2.0]), ("t1", "b", 1, [3.0, 4.0]), ("t2", "a", 2, [5.0, 6.0])]
    assert {len(r.f) for r in alignment.equalised(traces, ["roi"], "f").collect()} == {3}


def stack_file(images: list[np.ndarray], texts: dict[int, bytes], wide: bool = False) -> bytes:
    out = pa.BufferOutputStream()
    stream = stacks.StackStream(out, wide)
    for image in images:
        stream.add(image, texts)
    stream.flush(last=True)
    return out.getvalue().to_pybytes()


def small_tiff(images: np.ndarray, order: str = "<") -> bytes:
    """A classic TIFF stack of 16-bit images."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8))
    for k, image in enumerate(images):
        data = image.astype(np.dtype(np.int16).newbyteorder(order)).tobytes()
        at = len(out)
        pixels = at + 2 + 12 * 5 + 4
        tags = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, 16), (273, 4, pixels), (279, 4, len(data))]
        out += struct.pack(f"{order}H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack(f"{order}HHI", tag, kind, 1) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
        out += struct.pack(f"{order}I", pixels + len(data) if k < len(images) - 1 else 0) + data
    return bytes(out)


def test_tiff_stack(spark, tmp_path):
    images = np.arange(4 * 2 * 3).reshape(4, 2, 3) - 5
    for name, order in (("AA0001_1.tif", "<"), ("AA0001_2.tif", ">")):
        (tmp_path / name).write_bytes(small_tiff(images, order))
    (tmp_path / "notes.txt").write_text("x")
    listed = tiff.inventory(spark, str(tmp_path))
    assert sorted(r.name for r in listed.collect()) == ["AA0001_1.tif", "AA0001_2.tif"] and not listed.first().likely_map
    got = tiff.frames(spark, str(tmp_path), channels=2).collect()
    assert len(got) == 8
    for r in got:
        assert r.px == images[2 * (r.frame - 1) + r.chan - 1].ravel().tolist() and (r.h, r.w) == (2, 3)


def test_header_is_split_not_run(spark):
    df = spark.createDataFrame([("SI.a = 1\nSI.b = 'x = y'\nnothing\nSI.a = 2",)], "t string")
    assert df.select(tiff.header_map(F.col("t"))).first()[0] == {"SI.a": "2", "SI.b": "'x = y'"}


def test_header_of_many_lines(spark):
    """Work in proportion to the lines: 600 of them, each key twice, in both dialects, within seconds."""
    import time

    lines = [f"SI.k{i % 300} = {i}" for i in range(600)] + ["SI.hRoiManager.scanFrameRate = 5", "SI.hRoiManager.scanFrameRate = 30", "SI.hChannels.channelSave = [1;2]"]
    df = spark.createDataFrame([("\n".join(lines), None), (None, "\r".join(["state.acq.zoomFactor=2", "state.acq.numberOfChannelsSave=1"])), (None, None)] * 20, "software string, description string")
    start = time.perf_counter()
    got = tiff.with_header_fields(df, F.col("description"), F.col("software")).select("rate", "zoom", "channels").collect()
    assert [tuple(r) for r in got] == [(30.0, None, 2), (None, 2.0, 1), (None, None, None)] * 20
    assert time.perf_counter() - start < 20
    kept = df.limit(1).select(tiff.header_map(F.col("software"))).first()[0]
    assert len(kept) == 302 and kept["SI.k7"] == "307"


def test_manifest_and_cohort(spark, tmp_path):
    groups = [{"matfile": "g1/matlab.mat", "nROI": 18, "tifNames": ["b.tif", "a.tif"]}, {"matfile": "g2/matlab.mat", "nROI": 11, "tifNames": ["c.tif"]}]
    (tmp_path / "groups.json").write_text(json.dumps(groups, indent=1))
    got = sorted((r.matfile, r.trial, r.tif) for r in tables.manifest(spark, f"{tmp_path}/groups.json").collect())
    assert got == [("g1/matlab.mat", 1, "b.tif"), ("g1/matlab.mat", 2, "a.tif"), ("g2/matlab.mat", 1, "c.tif")]
    rows = spark.createDataFrame([("AA0001", "BPN", 1), ("AA0002", "CGC", 2)], "animal string, family string, x int")
    tables.write_cohort(rows, f"{tmp_path}/cohort")
    assert tables.read_cohort(spark, f"{tmp_path}/cohort", "BPN").collect()[0].x == 1
    with pytest.raises(ValueError, match="unknown family"):
        tables.read_cohort(spark, f"{tmp_path}/cohort", "nope")
    old = spark.createDataFrame([(1, 2)], "onset int, dBAmpl int")
    assert tables.renamed(tables.renamed(old)).columns == ["onset_s", "db"]


def test_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=10 * i), 1 + i % 2, "s", float(i)) for i in range(24)]
    schema = "event_id long, ts timestamp, cell long, stim string, value double"
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = online.samples(spark, f"{tmp_path}/in", "*.parquet", schema)
    online.append_batches(online.window_means(stream, "ts", ["stim"], "value", "1 hour", "10 minutes"), f"{tmp_path}/w", f"{tmp_path}/wc")
    got = spark.read.parquet(f"{tmp_path}/w").orderBy("start").collect()
    assert [(r.n, r["mean"]) for r in got] == [(6, 2.5), (6, 8.5), (6, 14.5)]  # the last hour is still open
    online.append_batches(online.running_peaks(stream, 3), f"{tmp_path}/p", f"{tmp_path}/pc", "update")
    last = {r.cell: r for r in spark.read.parquet(f"{tmp_path}/p").orderBy("n").collect()}
    assert last[1].n == 12 and last[1].pk == 22.0 and last[1].threshold == pytest.approx(2 + 2 * 2) and last[1].sig


def test_raw_movie_and_waveform(spark, tmp_path):
    from tracemill.sources import movies

    frames = np.arange(2 * 2 * 3, dtype="<u2").reshape(2, 2, 3)
    head = b"QCamRaw-Version: 1\r\nFixed-Header-Size: 128 [bytes]\r\nROI: 0, 0, 3, 2\r\nFrame-Size: 12 [bytes]\r\n\r\n".ljust(128, b"\0")
    (tmp_path / "a.qcamraw").write_bytes(head + frames.tobytes())
    got = {r.frame: r for r in movies.movies(spark, str(tmp_path)).collect()}
    assert {k: r.px for k, r in got.items()} == {1: list(range(6)), 2: list(range(6, 12))} and (got[1].h, got[1].w) == (2, 3)
    (tmp_path / "b.qcamraw").write_bytes(head + frames.tobytes()[:-2])
    with pytest.raises(Exception, match="do not fill the file"):
        movies.movies(spark, str(tmp_path)).collect()
    wave = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], 2.0)], "v array<double>, rate double")
    assert [tuple(x) for x in wave.select(movies.waveform_window(F.col("v"), F.col("rate"), 0.5, 1.0)).first()[0]] == [(0.5, 1.0), (1.0, 2.0)]


def test_headers_of_both_dialects(spark, tmp_path):
    """Frame rate, zoom and channels without pixels; 64-bit offsets; a header's text is never run."""
    newer = "SI.hRoiManager.scanFrameRate = 5.07\nSI.hRoiManager.scanZoomFactor = 2\nSI.hChannels.channelSave = [1;2]\nSI.x = __import__('os')"
    images = [np.full((2, 3), k) for k in range(4)]
    (tmp_path / "new.tif").write_bytes(stack_file(images, {stacks.COPYRIGHT: b"splitTif_channel_2\0", stacks.SOFTWARE: newer.encode() + b"\0"}))
    older = b"state.acq.frameRate=3.05\rstate.acq.zoomFactor=1\rstate.acq.numberOfChannelsSave=1\0"
    pixels = np.arange(6, dtype="<i2").tobytes()
    tags = [(256, 4, 1, 3), (257, 4, 1, 2), (258, 3, 1, 16), (270, 2, len(older), 16), (273, 16, 1, 16 + len(older)), (279, 4, 1, len(pixels))]
    at = 16 + len(older) + len(pixels)
    big = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) + older + pixels + struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", *t) for t in tags) + struct.pack("<Q", 0)
    (tmp_path / "old.tif").write_bytes(big)
    found = {r.path.rsplit("/", 1)[1]: r for r in tiff.headers(spark, str(tmp_path)).collect()}
    new, old = found["new.tif"], found["old.tif"]
    assert (new.rate, new.zoom, new.channels, new.h, new.w, new.copyright) == (5.07, 2.0, 2, 2, 3, "splitTif_channel_2")
    assert (old.rate, old.zoom, old.channels, old.rows) == (3.05, 1.0, 1, None)
    assert {r.path.rsplit("/", 1)[1]: r.images for r in tiff.image_counts(spark, str(tmp_path)).collect()} == {"new.tif": 4, "old.tif": 1}
    got = {r.frame: r.px for r in tiff.frames(spark, str(tmp_path), pattern="old.tif").collect()}
    assert got == {1: list(range(6))}


def test_stacks_are_split_and_cut_back(spark, tmp_path):
    """Channels to files and read again; a joined stack back into its recordings."""
    images = np.arange(6 * 2 * 3).reshape(6, 2, 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(stack_file(list(images), {stacks.COPYRIGHT: b"x\0"}))
    tiff.split_channels(spark, f"{tmp_path}/in", f"{tmp_path}/out", 2)
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["a_chan_1.tif", "a_chan_2.tif"]
    back = tiff.frames(spark, f"{tmp_path}/out").collect()
    assert {(r.path[-5], r.frame): r.px for r in back} == {(str(k % 2 + 1), k // 2 + 1): images[k].ravel().tolist() for k in range(6)}
    assert {r.copyright for r in tiff.headers(spark, f"{tmp_path}/out").collect()} == {"splitTif_channel_1", "splitTif_channel_2"}
    stack = spark.createDataFrame([("g", k + 1, 1, 1, [k]) for k in range(5)], "grp string, frame int, h int, w int, px array<short>")
    recorded = spark.createDataFrame([("g", "a", 2), ("g", "b", 3)], "grp string, tif string, n_frames int")
    assert sorted((r.tif, r.frame, r.px) for r in tiff.cut_back(stack, recorded, "grp", "tif").collect()) == [("a", 1, [0]), ("a", 2, [1]), ("b", 1, [2]), ("b", 2, [3]), ("b", 3, [4])]


def test_polygons_are_filled_by_the_even_odd_rule(spark):
    """Against a test of each pixel's centre; rings that cross themselves, with repeated corners, of one point, and outside of the image."""
    rng = np.random.default_rng(5)
    rings = {k: rng.uniform(-1, 11, (n, 2)) for k, n in enumerate([3, 4, 5, 9, 20])} | {7: np.array([[2, 2], [7, 2], [7, 2], [7, 6], [2, 6]]), 8: np.array([[3, 3]]), 9: np.array([[1, 1], [9, 1]])}
    rows = [(k, i, float(x), float(y)) for k, ring in rings.items() for i, (x, y) in enumerate(ring)]
    found = {}
    for r in roi.filled(spark.createDataFrame(rows, "roi int, n int, x double, y double").repartition(3), ["roi"]).collect():
        found.setdefault(r.roi, []).extend((r.row, c) for c in range(r.first, r.last + 1))

    def inside(ring, row, col):
        crossings = [x1 + (row - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0), strict=True) if (y1 <= row) != (y2 <= row)]
        return any(a <= col <= b for a, b in zip(sorted(crossings)[::2], sorted(crossings)[1::2], strict=True))

    for k, ring in rings.items():
        assert sorted(set(found.get(k, []))) == [(r, c) for r in range(-2, 13) for c in range(-2, 13) if inside(np.asarray(ring, float), r, c)]
    px = rng.normal(size=100)
    frames = spark.createDataFrame([(1, px.tolist())], "frame int, px array<double>")
    spans = spark.createDataFrame([(1, "a", 2, 3, 5), (1, "a", 4, 0, 2), (1, "a", 11, 1, 5), (1, "b", 1, 9, 14)], "frame int, roi string, row int, first int, last int")
    got = {r.roi: r.f for r in roi.interval_means(frames, spans, ["frame"], ["frame", "roi"], 10).collect()}
    assert got == pytest.approx({"a": np.mean([*px[12:15], *px[30:32]]), "b": np.mean(px[8:10])})


def test_cohort_notices_and_first_matches(spark, tmp_path):
    rows = spark.createDataFrame([("AA0001", "CGC", 1), ("AA0002", "BPN", 2)], "animal string, family string, x int")
    tables.write_cohort(rows, f"{tmp_path}/cohort")
    told = tables.cohort_notices(spark, f"{tmp_path}/cohort", "CGC", ["AA0001", "AA0002", "AA0003", "mouse"]).collect()
    assert {r.animal: r.notice for r in told} == {"AA0002": "no CGC", "AA0003": "no folder", "mouse": "no animal's name"}
    assert tables.columns_by_shape(rows.withColumn("f", F.array("x"))) == (["animal", "family", "x"], ["f"])
    several = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 0, None), ("b", 1, None)], "k string, n int, v string")
    assert [tuple(r) for r in relations.first_match(several, ["k"], ["n"], F.col("v").isNotNull()).collect()] == [("a", 1, "x")]


def test_crops_find_their_source(spark):
    """Named sources before nearer ones, nearer ones before others; none, ties and other geometry are errors."""
    columns = "animal string, condition string, has_rois boolean, rows int, cols int, zoom double, fast double, shift_x double, shift_y double, rotation double, pitch_x double, pitch_y double"
    field = lambda name, has, rows, cols, pitch=1.0, turn=0.0: ("a", name, has, rows, cols, 1.0, 1.0, 0.0, 0.0, turn, pitch, pitch)
    full = [field("preZX", True, 256, 256), field("postZX", True, 300, 256)]
    sources = lambda *more: {r.condition: (r.source, r.up, r.left) for r in roi.crop_sources(spark.createDataFrame([*full, *more], columns), ["animal"]).collect()}
    assert sources(field("postZX_128", False, 128, 256), field("other", False, 128, 200)) == {"postZX_128": ("postZX", 86, 0), "other": ("preZX", 64, 28)}
    for more, what in ((field("odd", False, 127, 256), "no source"), (field("zoomed", False, 128, 256, 0.5), "no source"), (field("turned", False, 128, 256, 1.0, 3.0), "no source")):
        with pytest.raises(roi.Unmappable, match=what):
            sources(more)
    with pytest.raises(roi.Unmappable, match="2 sources as near"):
        sources(field("none", True, 256, 256), field("x", False, 128, 256))
    pixels = spark.createDataFrame([("a", "preZX", "in", 65, 1, False), ("a", "preZX", "in", 192, 256, False), ("a", "preZX", "out", 64, 5, False), ("a", "preZX", "gone", 100, 5, True), ("a", "postZX", "elsewhere", 100, 5, False)], "animal string, condition string, roi string, row int, col int, deleted boolean")
    got = roi.remapped_everywhere(pixels, spark.createDataFrame([*full, field("x", False, 128, 256)], columns), ["animal"], "roi").collect()
    assert sorted((r.condition, r.source, r.roi, r.row, r.col) for r in got) == [("x", "preZX", "in", 1, 1), ("x", "preZX", "in", 128, 256)]


def test_versions_and_region_files(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "x int")
    assert [tables.append_version(rows, f"{tmp_path}/out") for _ in range(2)] == [1, 2]
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda _: tables.append_version(rows, f"{tmp_path}/out"), range(6)))
    assert sorted(numbers) == [3, 4, 5, 6, 7, 8]
    assert sorted(r.version for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(1, 9))
    (tmp_path / "sets").mkdir()
    (tmp_path / "sets" / "a.json").write_text(json.dumps({"nTifs": 2, "tifNames": ["a", "b"], "roi": ["p", "q", "r"]}))
    r = tables.roi_sets(spark, f"{tmp_path}/sets").first()
    assert (r.n_tifs, r.tif_names, r.n_roi) == (2, ["a", "b"], 3) and r.path.endswith("a.json")
    tables.write_manifest(spark.createDataFrame([("g1", 3, ["x", "y"])], tables.MANIFEST), f"{tmp_path}/m")
    assert [tuple(x) for x in tables.manifest_rows(spark.read.schema(tables.MANIFEST).json(f"{tmp_path}/m")).collect()] == [("g1", 3, 1, "x"), ("g1", 3, 2, "y")]


def test_only_clean_crops_are_mapped():
    source = {"rows": 256, "cols": 256, "zoom": 2.0, "fast": 1.0, "shift_x": 0.0, "shift_y": 0.0, "rotation": 0.0, "pitch_x": 0.5, "pitch_y": 0.5}
    assert roi.clean_crop(source, source | {"rows": 128}) == (64, 0)
    for bad in ({"zoom": 1.0}, {"fast": 0.5}, {"shift_x": 0.1}, {"rotation": 3.0}, {"pitch_y": 1.0}, {"rows": 127}, {"rows": 300}):
        with pytest.raises(roi.Unmappable):
            roi.clean_crop(source, source | bad)


def test_exactly_one_set_and_missing_columns(spark):
    from tracemill.operators import recordings

    names = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t9")], "grp string, tif string")
    sets = spark.createDataFrame([("s", "t1"), ("s", "t2"), ("s", "t3"), ("q", "t7")], "sid string, tif string")
    rows, sizes = spark.createDataFrame([("a", 5), ("b", 7)], "grp string, n int"), spark.createDataFrame([("s", 5), ("q", 7)], "sid string, n int")
    assert sorted(map(tuple, recordings.resolved_sets(names, sets, "grp", "sid", "tif", rows, sizes).collect())) == [("a", "s"), ("b", "q")]
    with pytest.raises(relations.MissingKey):
        recordings.resolved_sets(names, sets, "grp", "sid", "tif", rows, sizes.where("n = 5"))
    with pytest.raises(recordings.NotOne):
        recordings.only_row(rows.select("n"), "n")
    assert recordings.only_row(rows.where("n = 5").union(rows.where("n = 5")), "n").collect() == rows.where("n = 5").collect()
    with pytest.raises(ValueError, match="no column f"):
        recordings.canonical(rows, "f")
    assert recordings.columns_left(rows, ["n"]) == ["grp"]
    numbered = rows.select(F.explode(F.array(F.lit("cell10"), F.lit("cell9"))).alias("c")).distinct().orderBy(recordings.numeric_suffix(F.col("c")))
    assert [r.c for r in numbered.collect()] == ["cell9", "cell10"]


def test_numbered_stimuli_by_animal(spark):
    from tracemill.operators import stimuli

    rows = spark.createDataFrame([("a", "pre", 1.0), ("a", "post", None), ("a", "pre", 2.0), ("b", "pre", 5.0), ("a", "pre", 1.0)], "animal string, treatment string, db double")
    assert sorted((r.animal, r.treatment, r.db or 0, r.stim_id) for r in stimuli.numbered_stimuli(rows, ["db"]).collect()) == [("a", "post", 0, 3), ("a", "pre", 1.0, 2), ("a", "pre", 1.0, 2), ("a", "pre", 2.0, 1), ("b", "pre", 5.0, 1)]


def test_cells_of_all_conditions_both_ways(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "a"), (3, "a")], "cell int, condition string")
    counted = sorted(r.cell for r in relations.in_all_conditions(rows, ["cell"], "condition", ["a", "b"]).collect())
    assert counted == sorted(r.cell for r in relations.intersected([rows.where(F.col("condition") == c).select("cell") for c in "ab"]).collect()) == [1, 3]
