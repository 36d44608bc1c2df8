"""Filters against plain recurrences."""

from __future__ import annotations

import numpy as np
import pytest

from tracemill.operators import filters


def recurrence(x: np.ndarray, num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """One sample after the other, from the steady state of the first."""
    state, out = filters.steady_state(num, den) * x[0], []
    for v in x:
        y = num[0] * v + state[0]
        state = np.append(state[1:], 0.0) + num[1:] * v - den[1:] * y
        out.append(y)
    return np.array(out)


def both_ways(x: np.ndarray, order: int, cutoff: float) -> np.ndarray:
    num, den = filters.low_pass(order, cutoff)
    pad = min(3 * order, len(x) - 1)
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -2 - pad : -1]])
    y = recurrence(recurrence(long, num, den)[::-1], num, den)[::-1]
    return y[pad : pad + len(x)]


def test_low_pass_coefficients():
    """Tabled values of the second and third order, and what every low-pass does at both ends of the spectrum."""
    num, den = filters.low_pass(2, 0.5)
    assert num == pytest.approx([0.2928932188, 0.5857864376, 0.2928932188]) and den == pytest.approx([1, 0, 0.1715728753], abs=1e-9)
    num, den = filters.low_pass(3, 0.5)
    assert num == pytest.approx(np.array([1, 3, 3, 1]) / 6) and den == pytest.approx([1, 0, 1 / 3, 0], abs=1e-9)
    for order in range(1, 7):
        num, den = filters.low_pass(order, 0.3)
        at = np.exp(-1j * np.pi * 0.3 * np.arange(order + 1))
        assert num.sum() / den.sum() == pytest.approx(1) and abs(num @ (-1.0) ** np.arange(order + 1)) < 1e-9
        assert abs((num @ at) / (den @ at)) == pytest.approx(2**-0.5)
    with pytest.raises(ValueError):
        filters.low_pass(2, 1.0)


@pytest.mark.parametrize(("order", "block"), [(1, 7), (2, 16), (3, 50), (4, 1024)])
def test_blocks_pass_on_their_state(spark, order, block):
    """Traces of many lengths, cut into blocks of any size: as the recurrence over the whole trace."""
    rng = np.random.default_rng(order)
    traces = {(g, k): rng.normal(size=n).cumsum() for g, k, n in [("a", 1, 1), ("a", 2, 2), ("a", 3, 5), ("b", 1, 16), ("b", 2, 33), ("b", 3, 200)]}
    rows = [(g, k, i + 3, float(v)) for (g, k), x in traces.items() for i, v in enumerate(x)] + [("gap", 1, i, None if i == 4 else 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, k int, frame int, v double").repartition(3)
    found = {(r.g, r.k, r.frame): r.v for r in filters.zero_phase(df, ["g", "k"], order, 0.25, block=block).collect()}
    assert len(found) == len(rows) and all(found["gap", 1, i] is None for i in range(9))
    for (g, k), x in traces.items():
        want = both_ways(x, order, 0.25) if len(x) > 1 else x
        assert [found[g, k, i + 3] for i in range(len(x))] == pytest.approx(want.tolist(), abs=1e-9)


def test_constant_traces_stay(spark):
    df = spark.range(100).selectExpr("1 AS k", "id AS frame", "5D AS v")
    assert {round(r.v, 9) for r in filters.zero_phase(df, ["k"], 3, 0.1, block=8).collect()} == {5.0}
    assert filters.zero_phase(df.limit(0), ["k"], 3, 0.1).collect() == []
