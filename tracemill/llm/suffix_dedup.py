"""Suffix-array dedup of repeated byte strings.

Suffixes are sorted at anchors only: in each window of 100 bytes the 32-byte gram
of least hash, which equal windows choose alike. Grams that occur once in the
corpus cannot lie in a repeat, so only suffixes at repeated grams go on. Each task
sorts its suffixes to runs, front-coded by the prefix shared with the suffix
before; runs are dealt by gram, and merged with loser trees that carry common
prefixes along and never compare a known one again. Neighbours in the merged order
that share the gram are then judged window by window: two windows are equal if the
common prefix that the tree told of all suffixes between them reaches the window's
end, and they have as many bytes before the gram in common. A gram that very many documents share would gather their differing surroundings in one
task; around such a gram every suffix is sorted, dealt by its own bytes.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import PACKED, binaries, bucket_of, buckets_for, dealt, gathered, grouped_positions, mixed, outer_id, per_document, positions, row_keys, runs, slices, texts

LEAST, GRAM = 100, 32
PER_BUCKET = 250_000
#: A gram with more places is common: all suffixes around its places are sorted, dealt by their first 100 bytes instead of by the gram.
COMMON = 2000
#: Suffixes that a task sorts at a time.
RUN = 60_000
BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
INDEX = np.uint64((1 << 31) - 1)
MARK = 1 << 31


def least_grams(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window of ``least`` bytes the place of its gram of least hash, leftmost on ties; and all grams' hashes."""
    h = BYTE_HASH[data]
    for k in (1, 2, 4, 8, 16):
        h = h[:-k] * np.uint64(0xA0761D6478BD642F + 2 * k) + h[k:]
        h ^= h >> np.uint64(29)
    h = mixed(h)
    low = (h & ~INDEX) | np.arange(len(h), dtype=np.uint64)
    width, have = least - GRAM + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: have - width], low[width - have :])
    return (low & INDEX).astype(np.int64), h


class Anchors:
    """Anchors of a batch of texts: place, first and last window start (in the batch), row, and the grams' hashes."""

    def __init__(self, found: list[bytes], least: int):
        self.data = b"".join(found)
        size = np.array([len(x) for x in found], np.int64)
        self.start = np.cumsum(size) - size
        windows = np.maximum(size - least + 1, 0)
        self.place = np.empty(0, np.int64)
        if not windows.sum():
            return
        place, hashes = least_grams(np.frombuffer(self.data, np.uint8), least)
        begins = np.repeat(self.start - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        chosen = place[begins]
        edge = runs(chosen)
        self.place, self.low, self.high = chosen[edge[:-1]], begins[edge[:-1]], begins[edge[1:] - 1]
        self.row = np.repeat(np.arange(len(found)), windows)[edge[:-1]]
        self.hashes = hashes[self.place]


def marked(least: int, buckets: int):
    """The gram of each anchor, with its document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches, 2 << 20):
            own = Anchors(found, least)
            if len(own.place):
                yield dealt(batch.column(0).to_numpy()[own.row], own.place - own.start[own.row], own.hashes, buckets, exact=False)

    return run


def twice(common: int):
    """Documents and places of the grams that occur more than once (and of a few whose short hashes agree by chance); the top bit marks common ones."""

    def run(group: pa.Table) -> pa.Table:
        ids, places, hashes = gathered(group, exact=False)
        _, key, count = np.unique(hashes, return_inverse=True, return_counts=True)
        again = count[key] > 1
        places = places | np.where(count[key] > common, MARK, 0)
        return pa.Table.from_batches([grouped_positions(ids[again], places[again])])

    return run


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


RUN_NAMES = ["bucket", "shared", "rights", "lefts", "docs", "lows", "bytes", "pos", "_id"]
RUN_SCHEMA = "bucket int, shared binary, rights binary, lefts binary, docs binary, lows binary, bytes binary, pos binary, _id long"
Doc = tuple[int, int]  # id and key: documents of one id follow each other by their keys
Record = tuple[bytes, bytes, Doc, int]  # suffix from the gram on, what stands before it, document, first window start


def coded(bucket: int, records: list[Record]) -> list:
    """A sorted run: each suffix without the prefix that it shares with the one before."""
    shared, tails, last = [], [], b""
    for right, left, _, _ in records:
        k = common_prefix(last, right)
        shared.append(k)
        tails.append(right[k:])
        tails.append(left)
        last = right
    array = lambda x, kind: np.array(x, kind).tobytes()
    body = zstandard.compress(b"".join(tails), 3)
    return [bucket, array(shared, np.uint16), array([len(r[0]) for r in records], np.uint16), array([len(r[1]) for r in records], np.uint16), array([r[2] for r in records], np.int64), array([r[3] for r in records], np.uint32), body, None, None]


def decoded(row: dict) -> Iterator[tuple[int, Record]]:
    """(prefix shared with the suffix before, record) in order."""
    body, at, last = zstandard.decompress(row["bytes"]), 0, b""
    take = lambda k, kind: memoryview(row[k]).cast(kind)
    docs = iter(take("docs", "q"))
    for shared, right, left, doc, low in zip(take("shared", "H"), take("rights", "H"), take("lefts", "H"), zip(docs, docs, strict=True), take("lows", "I"), strict=True):
        last = last[:shared] + body[at : at + right - shared]
        at += right - shared
        yield shared, (last, body[at : at + left], doc, low)
        at += left


class LoserTree:
    """Merges sorted runs; a contender carries the prefix it shares with the last suffix given out."""

    def __init__(self, sources: list[Iterator[tuple[int, Record]]]):
        self.sources = sources
        self.width = 1 << max(0, len(sources) - 1).bit_length()
        self.now: list[Record | None] = [None] * self.width
        self.shared = [0] * self.width
        for k, x in enumerate(sources):
            self.now[k] = next(x, (0, None))[1]
        self.loser = [0] * self.width
        self.best = self.play(1)

    def play(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        winner, self.loser[node] = self.match(self.play(2 * node), self.play(2 * node + 1))
        return winner

    def match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.shared[a], self.shared[b]
        if p != q:  # the one that shares more with the last given out comes first
            return (a, b) if p > q else (b, a)
        k = common_prefix(x[0], y[0], p)
        a_first = x[0][k:] <= y[0][k:] if k == min(len(x[0]), len(y[0])) else x[0][k] < y[0][k]
        winner, loser = (a, b) if a_first else (b, a)
        self.shared[loser] = k
        return winner, loser

    def __iter__(self) -> Iterator[tuple[int, Record]]:
        while (record := self.now[self.best]) is not None:
            yield self.shared[self.best], record
            k = self.best
            self.shared[k], self.now[k] = next(self.sources[k], (0, None))
            node = (k + self.width) >> 1
            while node:
                k, self.loser[node] = self.match(k, self.loser[node])
                node >>= 1
            self.best = k


def window_spans(group: list[Record], shared: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(document's key, first, last window start) of windows that also start earlier, among suffixes of one gram in order.

    ``shared`` are the prefixes that each has in common with the one before.
    """
    variants: dict[tuple[bytes, bytes], list[tuple[Doc, int]]] = {}
    prefixes, lowest = [], 1 << 30  # of each variant with the one before
    for (right, left, doc, low), k in zip(group, shared, strict=True):
        lowest = min(lowest, k)
        if (places := variants.get((left, right))) is None:
            variants[left, right] = [(doc, low)]
            prefixes.append(lowest)
            lowest = 1 << 30
        else:
            places.append((doc, low))
    for (left, right), places in variants.items():
        first = min(places)
        n = len(left) + len(right) - least
        yield from ((doc[1], low, low + n) for doc, low in places if (doc, low) != first)
        places[:] = [first]
    if len(variants) < 2:
        return
    rows = [(left, right, doc, low, bytearray(len(left) + len(right) - least + 1)) for (left, right), [(doc, low)] in variants.items()]
    for before in range(least - GRAM + 1):  # equal windows have as many bytes before the gram
        earliest: dict[tuple[int, bytes], tuple[Doc, int]] = {}
        inside, stretch, after = [], 0, least - before
        for x, k in zip(rows, prefixes, strict=True):
            stretch += k < after  # suffixes of one stretch agree up to the window's end
            if 0 <= len(x[0]) - before < len(x[4]):
                inside.append(((stretch, x[0][len(x[0]) - before :]), x))
        for piece, (left, _, doc, low, _) in inside:
            here = (doc, low + len(left) - before)
            if earliest.setdefault(piece, here) > here:
                earliest[piece] = here
        if len(earliest) < len(inside):
            for piece, (left, _, doc, low, again) in inside:
                again[len(left) - before] = earliest[piece] < (doc, low + len(left) - before)
    for _, _, doc, low, again in rows:
        at = again.find(1)
        while at >= 0:
            end = again.find(0, at)
            end = len(again) if end < 0 else end
            yield doc[1], low + at, low + end - 1
            at = again.find(1, end)


def spans_batch(spans: array) -> pa.RecordBatch:
    """One row (_id, pos) per document, named by its key, with pairs of first and last window starts."""
    values = np.frombuffer(spans, np.int64).reshape(-1, 3)
    values = values[np.argsort(values[:, 0], kind="stable")]
    starts = runs(values[:, 0]) if len(values) else np.zeros(1, np.int64)
    ids = values[starts[:-1], 0]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), binaries(values[:, 1:].astype(np.uint32).ravel(), starts * 2)], ["_id", "pos"])


def sorted_runs(least: int, buckets: int):
    """Front-coded runs of the suffixes at repeated grams. Of equal contexts in a run only the earliest goes on; the others' windows are settled."""
    def emitted(records: list[tuple[int, bytes, bytes, Doc, int]]) -> Iterator[pa.RecordBatch]:
        records.sort()
        rows, own, settled, last = [], [], array("q"), None
        for bucket, right, left, doc, low in records:
            if last and last[0] != bucket:
                rows.append(coded(last[0], own))
                own = []
            if last == (bucket, right, left):
                if own[-1][2:] != (doc, low):  # else the same place of a repeated row
                    settled.extend((doc[1], low, low + len(left) + len(right) - least))
                continue
            own.append((right, left, doc, low))
            last = (bucket, right, left)
        rows.append(coded(last[0], own))
        done = spans_batch(settled)
        for x, pos in zip(done.column(0).to_pylist(), done.column(1).to_pylist(), strict=True):
            rows.append([x % buckets, None, None, None, None, None, None, pos, x])
        kinds = [pa.int32(), *[pa.binary()] * 7, pa.int64()]
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 5000], strict=True), kinds, strict=True)], RUN_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[tuple[int, bytes, bytes, Doc, int]] = []
        for batch, found in slices(batches, 2 << 20):
            own = Anchors(found, least)
            if not len(own.place):
                continue
            repeated = np.zeros(len(own.data), np.int8)
            for start, hits in zip(own.start.tolist(), batch.column("pos").to_pylist(), strict=True):
                at = positions(hits)
                repeated[start + (at & (MARK - 1))] = 1 + (at >= MARK)
            some = np.flatnonzero(repeated[own.place])
            docs = list(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))
            row = own.row[some]
            bucket = bucket_of(own.hashes[some], buckets).tolist()
            common = (repeated[own.place[some]] == 2).tolist()
            for b, place, low, high, doc, start, many in zip(bucket, own.place[some].tolist(), own.low[some].tolist(), own.high[some].tolist(), [docs[i] for i in row.tolist()], own.start[row].tolist(), common, strict=True):
                if many:
                    for k in range(low, high + 1):
                        piece = own.data[k : k + least]
                        records.append((xxhash.xxh3_64_intdigest(piece) % buckets, piece, b"", doc, k - start))
                else:
                    records.append((b, own.data[place : high + least], own.data[low:place], doc, low - start))
            if len(records) >= RUN:
                yield from emitted(records)
                records = []
        if records:
            yield from emitted(records)

    return run


def merged(least: int):
    """Merge a bucket's runs and judge the windows of suffixes that share a gram."""

    def run(group: pa.Table) -> pa.Table:
        settled = group.filter(pc.is_valid(group.column("pos"))).select(["_id", "pos"])
        sources = [decoded(x) for x in group.filter(pc.is_null(group.column("pos"))).to_pylist()]
        spans = array("q")
        if sources:
            together: list[Record] = []
            prefixes: list[int] = []
            for shared, record in LoserTree(sources):
                if shared < GRAM:
                    if len(together) > 1:
                        for span in window_spans(together, prefixes, least):
                            spans.extend(span)
                    together, prefixes = [], []
                together.append(record)
                prefixes.append(shared)
            if len(together) > 1:
                for span in window_spans(together, prefixes, least):
                    spans.extend(span)
        return pa.concat_tables([settled, pa.Table.from_batches([spans_batch(spans)])])

    return run


def cut(least: int):
    """Each document without the bytes that its repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches):
            gone, spans, kept = [], [], []
            for packed, text in zip(batch.column("pos").to_pylist(), found, strict=True):
                cover = np.zeros(len(text) + 1, np.int64)
                pairs = positions(packed).reshape(-1, 2)
                np.add.at(cover, pairs[:, 0], 1)
                np.add.at(cover, pairs[:, 1] + least, -1)
                stays = np.cumsum(cover[:-1]) == 0
                kept.append(np.frombuffer(text, np.uint8)[stays].tobytes() if len(pairs) else text)
                gone.append(len(text) - len(kept[-1]))
                spans.append(int((np.diff(stays.astype(np.int8), prepend=1) == -1).sum()))
            sizes, digests = [len(x) for x in found], [hashlib.sha256(x).hexdigest() for x in kept]
            rest = [c for c in ("rest",) if c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, gone, spans)], pa.array([x.decode("utf-8", "ignore") for x in kept]), pa.array(digests), batch.column(1), *map(batch.column, rest)], ["_id", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256", "own", *rest])

    return run


def by_key(found: DataFrame) -> DataFrame:
    return per_document(found).withColumnRenamed("_id", "key")


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, common: int = COMMON, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_text, kept_sha256, own) of every document, and the columns to ``carry`` along, so that no join has to bring them back.

    A byte goes if a string of ``least`` bytes around it also starts earlier, in a
    document of smaller id or before in the same one; strings overlap freely and
    are judged on the input. Texts of fewer bytes, null and empty ones lose
    nothing. A null id is smaller than any other. Rows that repeat id and text are
    one document and lose the same; rows that repeat an id, or have none, with other
    text are documents of their own, in the order of a hash. kept_text leaves out the
    rest of a character that a cut went through; own is the hash of the input's text.
    """
    rows = row_keys(texts(docs, id_col, text_col, carry))
    rest = [c for c in ("rest",) if carry]
    buckets = buckets_for(rows, "text", PER_BUCKET, (least - GRAM + 2) / 2)
    again = rows.select("key", "text").mapInArrow(marked(least, buckets), PACKED).groupBy("bucket").applyInArrow(twice(common), "_id long, pos binary")
    placed = rows.repartition("key")
    around = placed.join(by_key(again), "key").select("key", "_id", "pos", "text")
    found = around.mapInArrow(sorted_runs(least, buckets), RUN_SCHEMA).groupBy("bucket").applyInArrow(merged(least), "_id long, pos binary")
    result = placed.join(by_key(found), "key", "left").select("_id", F.xxhash64("text").alias("own"), "pos", "text", *rest)
    kinds = "".join(f", rest {rows.schema[c].dataType.simpleString()}" for c in rest)
    result = result.mapInArrow(cut(least), f"_id long, n_bytes long, n_removed long, n_spans long, kept_text string, kept_sha256 string, own long{kinds}")
    return result.select(outer_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256", "own", *[F.col(f"rest.{c}").alias(c) for c in carry])
