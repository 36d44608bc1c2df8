"""Interpolated modified Kneser-Ney language model of word pairs or triples.

Counting runs in few exchanges. Words by hash give the vocabulary; a word's number
grows as it gets rarer, so numbers of common words pack well. N-grams, distinct in
each task, are dealt by their inner words (of a triple the middle one, of a pair
none), so that what a context and what a continuation has to know lies in one
place: a context shares all but the last word, a continuation all but the first.
Inner words too frequent for one task are split into a grid of first by last
words, and only for those are the parts summed by a further exchange. Each reducer
writes one file of sorted hash arrays to the shared folder, which workers map into
memory to score texts: the operating system pages in what is read, and a mapping
holds no file descriptor, whatever the number of files.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import WordHashes, bucket_of, buckets_for, delete, inner_id, mixed, outer_id, restored, runs, settled, shared_dir, slices, squeezed, stage, staged
from tracemill.shipping import ship

ORDER = 3
PER_BUCKET = 1_000_000
#: Tokens that a task holds before it sends on what is distinct among them.
HELD = 1_500_000
#: Bits of an n-gram's hash that a file keeps. A file holds about PER_BUCKET n-grams, so one that was never seen is taken for one of them with probability of about 1e-6, at any size of corpus.
KEPT = 40
#: Files that a worker keeps mapped.
MAPPED = 1024
#: The end of a text, and the context of its first word; no word is empty.
END = b""


def model_dir(spark: SparkSession) -> str:
    """A new folder below the shared one, as a path that workers can map files from."""
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = "/" + base.removeprefix("file:").lstrip("/")
    elif ":/" in base:
        raise ValueError(f"the model is mapped into memory: spark.checkpoint.dir must be a mounted folder, not {base}")
    return f"{base}/lm-{uuid.uuid4().hex}"


def shelve(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write named arrays to one file, under another name first, so that a repeated task never leaves half a file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = (x.dtype.str, at, len(x))
        at += -(-x.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 8))
    os.replace(part, path)


@lru_cache(maxsize=MAPPED)
def shelf(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; a file that is not there is an error, since every part of a model has one."""
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    start = 8 + int.from_bytes(data[:8], "little")
    return {name: np.frombuffer(data, kind, n, start + at) for name, (kind, at, n) in json.loads(data[8:start]).items()}


def narrow(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as single bytes; the few from 255 on beside them."""
    big = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}_at": big.astype(np.uint32), f"{name}_big": values[big].astype(np.uint64)}


def widened(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = arrays[name][at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = arrays[f"{name}_big"][np.searchsorted(arrays[f"{name}_at"], at[big])]
    return out


def hashed(name: str, keys: np.ndarray, **values: np.ndarray) -> dict[str, np.ndarray]:
    """A sorted hash array: keys of KEPT bits as their upper 32 and the bits below, with counts."""
    order = np.argsort(keys)
    keys = keys[order]
    out = {f"{name}_hi": (keys >> np.uint64(KEPT - 32)).astype(np.uint32), f"{name}_lo": (keys & np.uint64((1 << (KEPT - 32)) - 1)).astype(np.uint8)}
    for k, v in values.items():
        out |= narrow(f"{name}_{k}", v[order])
    return out


def placed(arrays: dict[str, np.ndarray], name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys the sorted hash array has, and where."""
    high, low = arrays[f"{name}_hi"], arrays[f"{name}_lo"]
    if not len(high):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    wanted, rest = (keys >> np.uint64(KEPT - 32)).astype(np.uint32), (keys & np.uint64((1 << (KEPT - 32)) - 1)).astype(np.uint8)
    at = np.searchsorted(high, wanted)
    inside = np.minimum(at, len(high) - 1)
    same = (at < len(high)) & (high[inside] == wanted)
    has = same & (low[inside] == rest)
    left = np.flatnonzero(same & ~has)
    while len(left):  # few keys agree in the upper bits alone
        at[left] += 1
        left = left[at[left] < len(high)]
        left = left[high[at[left]] == wanted[left]]
        hit = low[at[left]] == rest[left]
        has[left[hit]] = True
        left = left[~hit]
    return has, np.where(has, at, 0)


def pair_keys(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """64-bit hashes of pairs of word numbers."""
    x = mixed(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind))
    return mixed((x + b.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))


def gram_keys(v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed((pair_keys(v, u, 3) + w.astype(np.uint64)) * np.uint64(0xA0761D6478BD642F))


CONTEXT, CONTINUATION = 1, 2


def short(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - KEPT)


def ascending(values: np.ndarray) -> bytes:
    """Sorted numbers, packed by their differences."""
    return squeezed(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def climbed(data: bytes) -> np.ndarray:
    return np.cumsum(restored(data, np.uint64), dtype=np.uint64)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = runs(keys)[:-1]
    return (keys[starts], *(np.add.reduceat(v[order], starts) if len(keys) else v for v in values))


def token_hashes(memo: WordHashes, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some texts, each text with its end, and their number by text."""
    words = [x.lower().split() + [END] for x in found]
    return np.concatenate([memo.of(x) for x in words]), np.array([len(x) for x in words], np.int64)


def of_rows(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


WORDS = "bucket int, keys binary, counts binary"


def word_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, n = WordHashes(), [], 0

        def sent() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = bucket_of(keys, buckets)
            edge = runs(bucket)
            return of_rows([(int(bucket[a]), ascending(keys[a:b]), squeezed(counts[a:b].astype(np.uint32))) for a, b in zip(edge, edge[1:], strict=False)], WORDS)

        for _, found in slices(batches):
            held.append(token_hashes(memo, found)[0])
            n += len(held[-1])
            if n >= HELD:
                yield sent()
                held, n = [], 0
        if held:
            yield sent()

    return run


def vocabulary_part(folder: str, buckets: int):
    """A part's words in order of hash, numbered from the most frequent on; numbers of all parts alternate."""

    def run(group: pa.Table) -> pa.Table:
        k = group.column("bucket")[0].as_py()
        group = group.filter(group.column("keys").is_valid())
        keys = np.concatenate([np.empty(0, np.uint64), *[climbed(x) for x in group.column("keys").to_pylist()]])
        counts = np.concatenate([np.empty(0, np.int64), *[restored(x, np.uint32).astype(np.int64) for x in group.column("counts").to_pylist()]])
        keys, counts = summed(keys, counts)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(keys), np.uint32)
        place[order] = np.arange(len(keys))
        shelve(f"{folder}/words-{k}", {"words": keys, "place": place, "counts": counts[order]})
        return pa.table({"n": [len(keys)], "total": [int(counts.sum())]})

    return run


@dataclass(frozen=True)
class Vocabulary:
    """Words by hash in parts; number = place in the part * parts + part."""

    folder: str
    buckets: int
    size: int
    total: int
    per_bucket: int

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        bucket = bucket_of(hashes, self.buckets)
        edge = runs(bucket)
        for a, b in zip(edge, edge[1:], strict=False):
            k = int(bucket[a])
            part = shelf(f"{self.folder}/words-{k}")
            if len(part["words"]):
                at = np.minimum(np.searchsorted(part["words"], hashes[a:b]), len(part["words"]) - 1)
                out[a:b] = np.where(part["words"][at] == hashes[a:b], part["place"][at].astype(np.int64) * self.buckets + k, -1)
        return out

    def values(self, file: str, names: list[str], numbers: np.ndarray) -> list[np.ndarray]:
        """Entries of arrays that are stored by word, for numbers that are known."""
        out = [np.zeros(len(numbers), np.float64) for _ in names]
        part = numbers % self.buckets
        order = np.argsort(part, kind="stable")
        edge = runs(part[order])
        for a, b in zip(edge, edge[1:], strict=False):
            some = order[a:b]
            arrays = shelf(f"{self.folder}/{file}-{int(part[some[0]])}")
            for x, name in zip(out, names, strict=True):
                x[some] = arrays[name][numbers[some] // self.buckets]
        return out

    def split_bits(self, inner: np.ndarray, order: int) -> np.ndarray:
        """Into how many cells, as a power of two, the n-grams around inner words are split."""
        counts = self.values("words", ["counts"], inner)[0] if order == 3 else np.full(len(inner), self.total, np.float64)
        return np.ceil(np.log2(np.maximum(counts / self.per_bucket, 1))).astype(np.int64)

    def cells(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The bucket of each n-gram: by its inner word, and where that is split by a row of first and a column of last words."""
        rows, columns = (bits + 1) // 2, bits // 2
        of = lambda x, n: ((mixed(x.astype(np.uint64) + np.uint64(1)) >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)
        salt = (of(u, rows) << columns) | of(w, columns)
        return bucket_of(pair_keys(v, salt, 0), self.buckets)


def numbered(vocabulary: Vocabulary, hashes: np.ndarray) -> np.ndarray:
    distinct, at = np.unique(hashes, return_inverse=True)
    return vocabulary.numbers(distinct)[at]


def before(tokens: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The token before each one; before a text's first, the end."""
    out = np.concatenate(([end], tokens[:-1]))
    out[np.cumsum(sizes)[:-1]] = end
    return out


def around(tokens: np.ndarray, sizes: np.ndarray, end: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inner word, first word, last word) of the n-gram that ends with each token; pairs have the inner word 0."""
    one = before(tokens, sizes, end)
    return (one, before(one, sizes, end), tokens) if order == 3 else (np.zeros(len(tokens), np.int64), one, tokens)


def distinct_grams(v: np.ndarray, u: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (v, u, w) in order, and the sums of their counts."""
    bits = [int(x.max(initial=0)).bit_length() for x in (v, u, w)]
    if sum(bits) <= 64:
        key = (v.astype(np.uint64) << np.uint64(bits[1] + bits[2])) | (u.astype(np.uint64) << np.uint64(bits[2])) | w.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        starts = runs(key[order])[:-1]
    else:
        order = np.lexsort((w, u, v))
        a, b, c = v[order], u[order], w[order]
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))) if len(a) else np.empty(0, np.int64)
    first = order[starts]
    return v[first], u[first], w[first], np.add.reduceat(counts[order], starts) if len(order) else counts


GRAMS = "bucket int, v binary, u binary, w binary, counts binary"


def told(v: np.ndarray, u: np.ndarray, w: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Sorted n-grams: inner words by their differences, first words by theirs under one inner word."""
    step = np.diff(u, prepend=0)
    starts = runs(v)[:-1]
    step[starts] = u[starts]
    return [ascending(v), squeezed(step.astype(np.uint64)), squeezed(w.astype(np.uint64)), squeezed(counts.astype(np.uint32))]


def heard(row: dict) -> tuple[np.ndarray, ...]:
    v, step, w = climbed(row["v"]).astype(np.int64), restored(row["u"], np.uint64).astype(np.int64), restored(row["w"], np.uint64).astype(np.int64)
    edge, total = runs(v), np.cumsum(step)
    base = np.repeat(total[edge[:-1]] - step[edge[:-1]], np.diff(edge))
    return v, total - base, w, restored(row["counts"], np.uint32).astype(np.int64)


def gram_counts(vocabulary: Vocabulary, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = WordHashes(), vocabulary.numbers(WordHashes().of([END]))[0]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            words, local = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            sizes = np.concatenate([x[1] for x in held])
            v, u, w, counts = distinct_grams(*around(local, sizes, int(np.searchsorted(words, end)), order), np.ones(len(local), np.int64))
            inner = words if order == 3 else np.zeros(1, np.int64)
            bits = vocabulary.split_bits(inner, order)[v]
            v, u, w = inner[v], words[u], words[w]
            bucket = vocabulary.cells(v, u, w, bits)
            by = np.argsort(bucket, kind="stable")
            v, u, w, counts, bucket = v[by], u[by], w[by], counts[by], bucket[by]
            edge = runs(bucket)
            return of_rows([(int(bucket[a]), *told(v[a:b], u[a:b], w[a:b], counts[a:b])) for a, b in zip(edge, edge[1:], strict=False)], GRAMS)

        for _, found in slices(batches, 4 << 20):
            hashes, sizes = token_hashes(memo, found)
            if held and sum(len(x[0]) for x in held) + len(hashes) > HELD:
                yield sent()
                held.clear()
            held.append((numbered(vocabulary, hashes), sizes))
        if held:
            yield sent()

    return run


#: What a part of the model gives to those that sum: of split inner words the contexts (kind CONTEXT) and continuations (CONTINUATION), of all words their sums (kind WORD), and counts of counts (kind TOTALS).
WORD, TOTALS = 3, 4
PARTS = "kind int, bucket int, a binary, b binary, x0 binary, x1 binary, x2 binary, x3 binary, x4 binary, n1 long, n2 long, n3 long, n4 long, m1 long, m2 long, m3 long, m4 long, more long, mass long"


def dealt_parts(kind: int, bucket: np.ndarray, keys: list[np.ndarray], values: list[np.ndarray]) -> list[tuple]:
    """Packed rows by bucket, for keys in order."""
    by = np.argsort(bucket, kind="stable")
    bucket, edge = bucket[by], runs(bucket[by])
    rows = []
    for a, b in zip(edge, edge[1:], strict=False):
        some = by[a:b]
        packed = [ascending(keys[0][some]), *[squeezed(x[some].astype(np.uint64)) for x in (*keys[1:], *values)]]
        names = [*packed[: len(keys)], *[None] * (2 - len(keys)), *packed[len(keys) :], *[None] * (5 - len(values))]
        rows.append((kind, int(bucket[a]), *names, *[0] * 10))
    return rows


def word_sums(v: np.ndarray, w: np.ndarray, times: np.ndarray, buckets: int) -> list[tuple]:
    """Of inner words the mass and classes of their continuations, of last words the number of inner ones, dealt by part of the vocabulary."""
    none = np.zeros(len(v), np.int64)
    one = lambda c: np.concatenate((c.astype(np.int64), none))
    words, *sums = summed(np.concatenate((v, w)), one(times), one(times == 1), one(times == 2), one(times > 2), np.concatenate((none, none + 1)))
    return dealt_parts(WORD, words % buckets, [words], sums)


def classes(times: np.ndarray) -> list[int]:
    return [int((times == c).sum()) for c in (1, 2, 3, 4)]


def core_part(vocabulary: Vocabulary, order: int):
    """Store a bucket's n-grams, and contexts and continuations of the inner words that it has whole."""

    def run(group: pa.Table) -> pa.Table:
        k = group.column("bucket")[0].as_py()
        group = group.filter(group.column("v").is_valid())
        parts = [heard(x) for x in group.to_pylist()]
        v, u, w, counts = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else [[]] * 4))
        inner, local = np.unique(v, return_inverse=True)
        local, u, w, counts = distinct_grams(local, u, w, counts)
        split = (vocabulary.split_bits(inner, order) > 0)[local] if len(inner) else np.empty(0, bool)
        v = inner[local] if len(inner) else v[:0]
        starts = np.flatnonzero(np.concatenate(([True], (local[1:] != local[:-1]) | (u[1:] != u[:-1])))) if len(u) else np.empty(0, np.int64)
        tally = lambda x: np.add.reduceat(x.astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
        contexts = [v[starts], u[starts], tally(counts), tally(counts == 1), tally(counts == 2), tally(counts > 2)]
        a, _, c, times = distinct_grams(local, np.zeros(len(w), np.int64), w, np.ones(len(w), np.int64))
        follows = [inner[a] if len(inner) else a, c, times]
        apart, apart_follows = split[starts] if len(starts) else split, (vocabulary.split_bits(inner, order) > 0)[a] if len(inner) else split
        rows = []
        if apart.any():
            some = [x[apart] for x in contexts]
            rows += dealt_parts(CONTEXT, bucket_of(pair_keys(*some[:2], CONTEXT), vocabulary.buckets), some[:2], some[2:])
            some = [x[apart_follows] for x in follows]
            rows += dealt_parts(CONTINUATION, bucket_of(pair_keys(*some[:2], CONTINUATION), vocabulary.buckets), some[:2], some[2:])
        contexts, follows = [x[~apart] for x in contexts], [x[~apart_follows] for x in follows]
        rows += word_sums(*follows, vocabulary.buckets) if order == 3 and len(follows[0]) else []
        times = follows[2]
        rows.append((TOTALS, k, *[None] * 7, *classes(counts), *classes(times), int((times > 2).sum()), int(times.sum())))
        shelve(f"{vocabulary.folder}/core-{k}", hashed("gram", short(gram_keys(v, u, w)), n=counts) | sides(contexts, follows))
        return pa.Table.from_batches([of_rows(rows, PARTS)])

    return run


def sides(contexts: list[np.ndarray], follows: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Sorted hash arrays of contexts, those seen once by their hash alone, and of continuations."""
    v, u, total, one, two, more = contexts
    keys, lone = short(pair_keys(v, u, CONTEXT)), total == 1
    rich = {n: x[~lone] for n, x in (("total", total), ("one", one), ("two", two), ("more", more))}
    return hashed("lone", keys[lone]) | hashed("context", keys[~lone], **rich) | hashed("follow", short(pair_keys(*follows[:2], CONTINUATION)), n=follows[2])


def split_part(vocabulary: Vocabulary, order: int):
    """Sum and store contexts and continuations of split inner words."""

    def run(group: pa.Table) -> pa.Table:
        k = group.column("bucket")[0].as_py()
        rows = []
        kept = {}
        for kind, width in ((CONTEXT, 4), (CONTINUATION, 1)):
            own = [x for x in group.to_pylist() if x["kind"] == kind]
            a = np.concatenate([np.empty(0, np.int64), *[climbed(x["a"]).astype(np.int64) for x in own]])
            b, *values = (np.concatenate([np.empty(0, np.int64), *[restored(x[c], np.uint64).astype(np.int64) for x in own]]) for c in ("b", "x0", "x1", "x2", "x3")[: 1 + width])
            order_of = np.lexsort((b, a))
            a, b = a[order_of], b[order_of]
            starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
            kept[kind] = [a[starts], b[starts], *[np.add.reduceat(x[order_of], starts) if len(starts) else x for x in values]]
        shelve(f"{vocabulary.folder}/split-{k}", sides(kept[CONTEXT], kept[CONTINUATION]))
        follows = kept[CONTINUATION]
        times = follows[2]
        rows += word_sums(*follows, vocabulary.buckets) if order == 3 and len(times) else []
        rows.append((TOTALS, k, *[None] * 7, 0, 0, 0, 0, *classes(times), int((times > 2).sum()), int(times.sum())))
        return pa.Table.from_batches([of_rows(rows, PARTS)])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts of counts 1, 2 and more; half a count where a class is empty."""
    if not n1:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    ratio = [(n2, n1), (n3, n2), (n4, n3)]
    return tuple(min(max(k - (k + 1) * y * a / b, 0.05), k - 0.05) if b else 0.5 for k, (a, b) in enumerate(ratio, 1))


def word_part(vocabulary: Vocabulary, less: tuple[float, float, float]):
    """Sum what the parts know of a part of the vocabulary; store inner words' totals and weights, and last words' inner ones."""

    def run(group: pa.Table) -> pa.Table:
        k = group.column("bucket")[0].as_py()
        n = len(shelf(f"{vocabulary.folder}/words-{k}")["words"])
        sums = [np.zeros(n, np.float64) for _ in range(5)]
        for row in group.to_pylist():
            if row["a"] is not None:
                at = climbed(row["a"]).astype(np.int64) // vocabulary.buckets
                for i, x in enumerate(sums):
                    x[at] += restored(row[f"x{i}"], np.uint64)
        total, one, two, more, inner = sums
        weight = np.where(total > 0, (less[0] * one + less[1] * two + less[2] * more) / np.maximum(total, 1), 1.0)
        shelve(f"{vocabulary.folder}/sums-{k}", {"total": total, "weight": weight, "inner": inner})
        return pa.table({f"n{c}": [int((inner == c).sum())] for c in (1, 2, 3, 4)} | {"more": [int((inner > 2).sum())], "mass": [int(inner.sum())]})

    return run


def cut(counts: np.ndarray, less: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(counts - np.where(counts > 2, less[2], np.where(counts > 1, less[1], np.where(counts > 0, less[0], 0.0))), 0)


@dataclass(frozen=True)
class Level:
    """Discounts of a level, and for the lowest one the mass of its counts and the share that it leaves."""

    less: tuple[float, float, float]
    mass: int = 1
    weight: float = 1.0


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    order: int
    levels: tuple[Level, ...]  # from the highest order on

    def looked_up(self, name: str, fields: list[str], bucket: np.ndarray, keys: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which n-grams the model has, and their counts; ``split`` says in which of a bucket's two files to look."""
        asked, at = np.unique((((bucket * 2 + split).astype(np.uint64)) << np.uint64(KEPT)) | short(keys), return_inverse=True)
        file = (asked >> np.uint64(KEPT)).astype(np.int64)
        asked &= np.uint64((1 << KEPT) - 1)
        has, out = np.zeros(len(asked), bool), [np.zeros(len(asked), np.int64) for _ in fields]
        edge = runs(file)
        for a, b in zip(edge, edge[1:], strict=False):
            arrays = shelf(f"{self.vocabulary.folder}/{'split' if file[a] % 2 else 'core'}-{int(file[a]) // 2}")
            own, place = placed(arrays, name, asked[a:b])
            has[a:b] = own
            for x, f in zip(out, fields, strict=True):
                if len(arrays[f"{name}_{f}"]):
                    x[a:b] = np.where(own, widened(arrays, f"{name}_{f}", place), 0)
        return has[at], [x[at] for x in out]

    def logs(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token, and its count in training."""
        vocabulary, order = self.vocabulary, self.order
        distinct, at = np.unique(hashes, return_inverse=True)
        own = vocabulary.numbers(distinct)
        known = np.flatnonzero(own >= 0)
        seen, total, weight, inner = np.zeros(len(distinct)), np.zeros(len(distinct)), np.ones(len(distinct)), np.zeros(len(distinct))
        seen[known] = vocabulary.values("words", ["counts"], own[known])[0]
        if order == 3:
            total[known], weight[known], inner[known] = vocabulary.values("sums", ["total", "weight", "inner"], own[known])
        end = int(np.searchsorted(distinct, WordHashes().of([END])[0]))  # every text has one
        v, u, w = around(at, sizes, end, order)
        inner_known = (own[v] >= 0) if order == 3 else np.ones(len(w), bool)
        core = own[v] if order == 3 else np.zeros(len(w), np.int64)
        bits = np.zeros(len(distinct), np.int64)
        bits[known] = vocabulary.split_bits(own[known], order)
        bits = bits[v] if order == 3 else np.full(len(w), int(vocabulary.split_bits(np.zeros(1, np.int64), order)[0]))
        whole, last = np.flatnonzero(inner_known & (own[u] >= 0)), np.flatnonzero(inner_known & (own[w] >= 0))
        home = lambda some, keys: np.where(bits[some] > 0, bucket_of(keys, vocabulary.buckets), vocabulary.cells(core[some], core[some], core[some], np.zeros(len(some), np.int64)))
        top, mass, left, times = np.zeros(len(w)), np.zeros(len(w)), np.ones(len(w)), np.zeros(len(w))
        some = whole[own[w[whole]] >= 0]
        top[some] = self.looked_up("gram", ["n"], vocabulary.cells(core[some], own[u[some]], own[w[some]], bits[some]), gram_keys(core[some], own[u[some]], own[w[some]]), np.zeros(len(some), np.int64))[1][0]
        keys = pair_keys(core[whole], own[u[whole]], CONTEXT)
        where = home(whole, keys), keys, (bits[whole] > 0).astype(np.int64)
        less = self.levels[0].less
        _, (sum_of, one, two, more) = self.looked_up("context", ["total", "one", "two", "more"], *where)
        lone, _ = self.looked_up("lone", [], *where)
        mass[whole] = np.where(lone, 1, sum_of)
        left[whole] = np.where(lone, less[0], np.where(sum_of > 0, (less[0] * one + less[1] * two + less[2] * more) / np.maximum(sum_of, 1), 1.0))
        keys = pair_keys(core[last], own[w[last]], CONTINUATION)
        times[last] = self.looked_up("follow", ["n"], home(last, keys), keys, (bits[last] > 0).astype(np.int64))[1][0]
        low = self.levels[-1]
        lowest = cut(inner, low.less)[w] / max(low.mass, 1) if order == 3 else 0.0
        uniform = 1.0 / (vocabulary.size + 1)
        middle = cut(times, self.levels[1].less) / np.maximum(total[v], 1) + weight[v] * (lowest + low.weight * uniform) if order == 3 else cut(times, low.less) / max(low.mass, 1) + low.weight * uniform
        return np.log10(cut(top, less) / np.maximum(mass, 1) + left * middle), seen[at]


def level(n: tuple[int, int, int, int], more: int, mass: int) -> Level:
    less = discounts(*n)
    return Level(less, mass, (less[0] * n[0] + less[1] * n[1] + less[2] * more) / max(mass, 1))


def learn(docs: DataFrame, order: int = ORDER, folder: str | None = None) -> Model | None:
    """Count (_id, text) and store the model; None if there is no row to learn from."""
    if order not in (2, 3):
        raise ValueError(f"order must be 2 or 3, not {order}")
    spark = docs.sparkSession
    folder = folder or model_dir(spark)
    buckets = buckets_for(docs, "text", PER_BUCKET, 6.0)
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))  # each part writes its file, if an empty one
    with_all = lambda df: df.unionByName(every, allowMissingColumns=True)
    counted = with_all(docs.mapInArrow(word_counts(buckets), WORDS)).groupBy("bucket").applyInArrow(vocabulary_part(folder, buckets), "n long, total long")
    size, total = counted.agg(F.sum("n"), F.sum("total")).first()
    if not size:
        return None
    vocabulary = Vocabulary(folder, buckets, size, total, PER_BUCKET)
    grams = with_all(docs.mapInArrow(gram_counts(vocabulary, order), GRAMS))
    parts = stage(grams.groupBy("bucket").applyInArrow(core_part(vocabulary, order), PARTS), "lm-parts")
    apart = with_all(parts.where(F.col("kind").isin(CONTEXT, CONTINUATION)))
    split = stage(apart.groupBy("bucket").applyInArrow(split_part(vocabulary, order), PARTS), "lm-split")
    both = parts.unionByName(split)
    n = both.where(F.col("kind") == TOTALS).agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4", "more", "mass")]).first()
    top, follows = Level(discounts(*n[:4])), level(n[4:8], n[8], n[9])
    if order == 2:
        return Model(vocabulary, order, (top, follows))
    words = with_all(both.where(F.col("kind") == WORD)).groupBy("bucket").applyInArrow(word_part(vocabulary, follows.less), "n1 long, n2 long, n3 long, n4 long, more long, mass long")
    m = words.agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4", "more", "mass")]).first()
    return Model(vocabulary, order, (top, follows, level(m[:4], m[4], m[5])))


def scores(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        total, size = (model.vocabulary.total, model.vocabulary.size) if model else (0, 0)
        for batch, found in slices(batches, 6 << 20):
            hashes, sizes = token_hashes(memo, found)
            if model:
                logs, seen = model.logs(hashes, sizes)
            else:
                logs, seen = np.zeros(len(hashes)), np.zeros(len(hashes))
            base = np.log10((seen + 0.5) / (total + 0.5 * (size + 1)))
            starts = np.cumsum(sizes) - sizes
            by_text = lambda x: np.add.reduceat(x, starts)
            columns = [pa.array(sizes), pa.array(by_text((seen > 0).astype(np.int64))), pa.array(np.full(len(sizes), total, np.int64)), pa.array(by_text(base)), pa.array(by_text(logs))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every document.

    Learns from the documents that are not held out: by default those whose
    crc32(doc_id) mod 5 is not 1. Lower-cases A-Z; tokens are the runs without
    ASCII white space and one end for each text, so null and empty texts have one
    token. score is the sum of log10 p(token | the order - 1 tokens before),
    interpolated with the continuation probabilities of shorter contexts and a
    uniform share for unknown words; the end also stands for what precedes a text. A
    null id is not held out. Repeated rows are learnt from each time. With nothing to
    learn from, scores are 0 and base scores those of no counts. The scores are
    written to the shared folder and the model is deleted.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False)) if held_out is None else held_out
    rows = docs.select(inner_id(id_col).alias("_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    folder, begun = model_dir(spark), staged()
    model = learn(rows.where(~F.col("held_out")).select("_id", "text"), order, folder)
    found = settled(rows.mapInArrow(scores(model), "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores", begun)
    delete(spark, f"file://{folder}")
    return found.select(outer_id().alias("doc_id"), *found.columns[1:], F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


#: The model of order 3 in SQL, with scores rounded to six digits; crc32 is spelt out by bits.
ORACLE = r"""
WITH doc AS (
  SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS ws,
         xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')], lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT FOR k IN range(8)], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 5 = 1 AS held_out FROM documents),
tok AS (SELECT doc_id, held_out, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM doc),
g AS (SELECT doc_id, held_out, w, coalesce(lag(w, 1) OVER d, '') AS v, coalesce(lag(w, 2) OVER d, '') AS u FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
seen AS (SELECT w, count(*) AS c FROM g WHERE NOT held_out GROUP BY w), size AS (SELECT sum(c) AS total, count(*) AS words FROM seen),
t3 AS (SELECT u, v, w, count(*) AS c FROM g WHERE NOT held_out GROUP BY ALL), t2 AS (SELECT v, w, count(*) AS c FROM t3 GROUP BY ALL), t1 AS (SELECT w, count(*) AS c FROM t2 GROUP BY ALL),
n AS (SELECT o, count(*) FILTER (c = 1)::DOUBLE AS a, count(*) FILTER (c = 2)::DOUBLE AS b, count(*) FILTER (c = 3)::DOUBLE AS e, count(*) FILTER (c = 4)::DOUBLE AS f FROM (SELECT 3 AS o, c FROM t3 UNION ALL SELECT 2, c FROM t2 UNION ALL SELECT 1, c FROM t1) GROUP BY o),
y AS (SELECT *, a / nullif(a + 2 * b, 0) AS y FROM n),
d AS (SELECT o, coalesce(least(greatest(1 - 2 * y * b / nullif(a, 0), 0.05), 0.95), 0.5) AS d1, CASE WHEN a = 0 OR b = 0 THEN 0.5 ELSE least(greatest(2 - 3 * y * e / b, 0.05), 1.95) END AS d2, CASE WHEN a = 0 OR e = 0 THEN 0.5 ELSE least(greatest(3 - 4 * y * f / e, 0.05), 2.95) END AS d3 FROM y),
k3 AS (SELECT t3.*, CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS less FROM t3, d WHERE o = 3), k2 AS (SELECT t2.*, CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS less FROM t2, d WHERE o = 2), k1 AS (SELECT t1.*, CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS less FROM t1, d WHERE o = 1),
s3 AS (SELECT u, v, sum(c) AS t, sum(less) AS l FROM k3 GROUP BY ALL), s2 AS (SELECT v, sum(c) AS t, sum(less) AS l FROM k2 GROUP BY v), s1 AS (SELECT sum(c) AS t, sum(less) AS l FROM k1),
p1 AS (SELECT g.*, coalesce(greatest(k1.c - k1.less, 0), 0) / s1.t + s1.l / s1.t / (words + 1) AS p FROM g CROSS JOIN s1 CROSS JOIN size LEFT JOIN k1 ON k1.w = g.w),
p2 AS (SELECT p1.* REPLACE (CASE WHEN s2.t IS NULL THEN p ELSE coalesce(greatest(k2.c - k2.less, 0), 0) / s2.t + s2.l / s2.t * p END AS p) FROM p1 LEFT JOIN s2 ON s2.v = p1.v LEFT JOIN k2 ON k2.v = p1.v AND k2.w = p1.w),
p3 AS (SELECT p2.* REPLACE (CASE WHEN s3.t IS NULL THEN p ELSE coalesce(greatest(k3.c - k3.less, 0), 0) / s3.t + s3.l / s3.t * p END AS p) FROM p2 LEFT JOIN s3 ON s3.u = p2.u AND s3.v = p2.v LEFT JOIN k3 ON k3.u = p2.u AND k3.v = p2.v AND k3.w = p2.w)
SELECT doc_id, held_out, count(*) AS n_tokens, count(seen.c) AS n_known, max(total)::BIGINT AS train_tokens, round(sum(log10((coalesce(seen.c, 0) + 0.5) / (total + 0.5 * (words + 1)))), 6) + 0.0 AS base_score, round(sum(log10(p)), 6) + 0.0 AS score
FROM p3 CROSS JOIN size LEFT JOIN seen ON seen.w = p3.w GROUP BY doc_id, held_out
"""
