"""Recursive low-pass filters run forward and backward over traces of any length, block by block.

A filter of order n is linear in its input and in a state of n numbers. Each block of
a trace is filtered from a state of zeros at once; the states in which blocks really
start follow from the blocks' end states and a power of the state's matrix, a few
numbers a block; each block then adds the response to its state. Work is linear in a
trace, and no task needs more of it than a block and the list of its states.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.shipping import ship

#: Samples of a block.
BLOCK = 1024


def low_pass(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the maximally flat low-pass of an order; ``cutoff`` as a share of half the sampling rate.

    The analogue filter's poles lie evenly on a half circle; the bilinear map takes each
    to the digital plane, and all zeros to -1.
    """
    if order < 1 or not 0 < cutoff < 1:
        raise ValueError("an order of 1 or more and a cutoff between 0 and 1 are wanted")
    radius = math.tan(math.pi * cutoff / 2)
    poles = radius * np.exp(1j * math.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    den = np.real(np.poly((1 + poles) / (1 - poles)))
    num = np.real(np.poly(-np.ones(order)))
    return num * den.sum() / num.sum(), den


def state_matrix(den: np.ndarray) -> np.ndarray:
    n = len(den) - 1
    out = np.zeros((n, n))
    out[:, 0] = -den[1:]
    out[:-1, 1:] += np.eye(n - 1)
    return out


def steady_state(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """The state in which a constant input of 1 gives a constant output of 1."""
    return np.linalg.solve(np.eye(len(den) - 1) - state_matrix(den), num[1:] - den[1:] * num[0])


def run_blocks(x: np.ndarray, lengths: np.ndarray, state: np.ndarray, num: np.ndarray, den: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and end states of blocks (rows of ``x``, of ``lengths`` samples) from their start states, all side by side."""
    y, state, end = np.empty_like(x), state.copy(), state.copy()
    for k in range(x.shape[1]):
        v = x[:, k]
        y[:, k] = out = num[0] * v + state[:, 0]
        ahead = np.hstack([state[:, 1:], np.zeros((len(x), 1))])
        state = ahead + v[:, None] * num[1:] - out[:, None] * den[1:]
        last = lengths == k + 1
        end[last] = state[last]
    return y, end


def padded(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column(column)
    lengths = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values.flatten().to_numpy()
    return out, lengths


def lists(rows: np.ndarray, lengths: np.ndarray) -> pa.Array:
    flat = rows[np.arange(rows.shape[1]) < lengths[:, None]]
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), flat)


def one_way(blocks: DataFrame, keys: list[str], num: np.ndarray, den: np.ndarray) -> DataFrame:
    """(keys, block, x) filtered in the order of blocks, from the steady state of the first value."""
    n, zero = len(den) - 1, steady_state(num, den)
    names = [*keys, "block", "x"]
    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in names)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lengths = padded(batch, "x")
            _, end = run_blocks(x, lengths, np.zeros((len(x), n)), num, den)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "block")), pa.array(lengths.astype(np.int32)), pa.array(x[:, 0]), lists(end, np.full(len(end), n))], [*keys, "block", "length", "first", "ended"])

    def starts(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        state, out, powers = zero * group.column("first")[0].as_py(), [], {}
        for length, ended in zip(group.column("length").to_pylist(), group.column("ended").to_pylist(), strict=True):
            out.append(state)
            if length not in powers:
                powers[length] = np.linalg.matrix_power(state_matrix(den), length)
            state = powers[length] @ state + np.array(ended)
        return pa.table([*(group.column(c) for c in (*keys, "block")), pa.array([s.tolist() for s in out], pa.list_(pa.float64()))], names=[*keys, "block", "state"])

    def corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lengths = padded(batch, "x")
            y, _ = run_blocks(x, lengths, np.array(batch.column("state").to_pylist()).reshape(-1, n), num, den)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "block")), lists(y, lengths)], names)

    told = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in (*keys, "block"))
    ended = blocks.select(*names).mapInArrow(ends, f"{told}, length int, first double, ended array<double>")
    state = ended.groupBy(*keys).applyInArrow(starts, f"{told}, state array<double>")  # a few numbers a block
    return blocks.join(state, [*keys, "block"]).select(*names, "state").mapInArrow(corrected, kinds)


def zero_phase(rows: DataFrame, keys: list[str], order: int, cutoff: float, at: str = "frame", value: str = "v", block: int = BLOCK) -> DataFrame:
    """(keys, at, value): traces filtered forward and backward, so that nothing is shifted.

    ``at`` numbers a trace's samples without gaps. Both ends are lengthened by the
    trace turned about its end point, three samples for each order (fewer where a trace
    is shorter), and cut again. A trace with a missing value is missing altogether; keys
    must not be missing.
    """
    ship(rows.sparkSession)
    num, den = low_pass(order, cutoff)
    x = F.col(value).cast("double")
    ends = rows.groupBy(*keys).agg(F.min(at).alias("_from"), F.max(at).alias("_to"), F.min_by(x, at).alias("_head"), F.max_by(x, at).alias("_tail"), F.count_if(x.isNull() | F.isnan(x)).alias("_gaps"))
    whole = rows.join(ends.where("_gaps = 0"), keys)
    pad = F.least(F.lit(3 * order), F.col("_to") - F.col("_from"))
    first, last = F.col(at) - F.col("_from"), F.col("_to") - F.col(at)
    own = F.struct((first + pad).cast("long").alias("p"), x.alias("v"))
    before = F.struct((pad - first).cast("long").alias("p"), (2 * F.col("_head") - x).alias("v"))
    after = F.struct((F.col("_to") - F.col("_from") + pad + last).cast("long").alias("p"), (2 * F.col("_tail") - x).alias("v"))
    each = F.filter(F.array(own, F.when(first.between(1, pad), before), F.when(last.between(1, pad), after)), lambda s: s.isNotNull())
    long = whole.select(*keys, F.explode(each).alias("s")).withColumn("block", F.floor(F.col("s.p") / block).cast("long"))
    blocks = long.groupBy(*keys, "block").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("x"))
    back = one_way(blocks, keys, num, den).select(*keys, (-F.col("block")).alias("block"), F.reverse("x").alias("x"))
    smooth = one_way(back, keys, num, den).select(*keys, (-F.col("block")).alias("block"), F.posexplode(F.reverse("x")).alias("nth", value))
    placed = smooth.join(ends, keys).withColumn(at, (F.col("block") * block + F.col("nth") - pad + F.col("_from")).cast(rows.schema[at].dataType))
    return rows.select(*keys, at).join(placed.where(F.col(at).between(F.col("_from"), F.col("_to"))).select(*keys, at, value), [*keys, at], "left")
