"""Benchmark decontamination on a positional inverted index of the training corpus.

The documents are read once. Every few megabytes of them become a segment of the
index, stored in the shared folder: all terms in order, and for each its places. A
phrase lies in one document and so in one segment, which makes the lists that are
intersected local, however frequent a term is. The benchmark's windows are looked up
block by block, on the stored index alone: the terms of a block are counted over all
segments, and of each window the places of its rarest term, less the offset in the
window, are the possible starts, which the lists of the next rarest terms, adjusted
by their offsets, thin out one after the other. What is left is an exact phrase. With
``slop`` the second list may disagree by so many words; what is no exact phrase then
is a proximity match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import WordHashes, outer_id, restored, runs, settled, slices, squeezed, stage, staged, texts
from tracemill.llm.license_scan import folded_words

WINDOW = 10
#: Windows of the benchmark that one pass over the index looks up; more are taken in further blocks.
BLOCK = 50_000


def item_windows(n: int):
    """(item, window, terms): windows of n words; a shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch, found in slices(batches):
            items, keys, terms = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), found, strict=True):
                words = memo.of(folded_words(text))
                for k in range(max(1, len(words) - n + 1) if len(words) else 0):
                    own = words[k : k + n]
                    items.append(item)
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=8).digest())
                    terms.append(own.astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(terms, pa.list_(pa.int64()))], ["item", "win", "terms"])

    return run


SEGMENT = "docs binary, ids binary, owns binary, lengths binary, terms binary, counts binary, places binary"


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each few megabytes of text: its documents with their numbers of words, its terms in order, and the places of each, counted through the segment."""
    memo = WordHashes()
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    for batch, found in slices(batches):
        words = [memo.of(folded_words(x)) for x in found]
        flat = np.concatenate(words) if words else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable").astype(np.uint32)
        flat = flat[order]
        starts = runs(flat)
        steps = np.diff(order, prepend=np.uint32(0))
        steps[starts[:-1]] = order[starts[:-1]]
        terms, counts = flat[starts[:-1]], np.diff(starts).astype(np.uint32)
        owners = [batch.column(k).to_numpy().astype(np.int64) for k in range(3)]
        packed = [*owners, np.array([len(x) for x in words], np.uint32), np.diff(terms, prepend=np.uint64(0)), counts, steps]
        yield pa.RecordBatch.from_arrays([pa.array([squeezed(x)], pa.binary()) for x in packed], names)


def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, _id, own, n_words) of the documents of each segment."""
    for batch in batches:
        for row in batch.to_pylist():
            columns = [restored(row[c], k).astype(np.int64) for c, k in (("docs", np.int64), ("ids", np.int64), ("owns", np.int64), ("lengths", np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "_id", "own", "n_words"])


def held(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the ``wanted`` stands among the sorted ``terms``, and whether it does."""
    at = np.searchsorted(terms, wanted)
    inside = at < len(terms)
    inside[inside] = terms[at[inside]] == wanted[inside]
    return at, inside


def counted(wanted: np.ndarray):
    """How often each of the sorted terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                at, inside = held(np.cumsum(restored(row["terms"], np.uint64)), wanted)
                total[inside] += restored(row["counts"], np.uint32)[at[inside]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["term", "n"])

    return run


class Plan:
    """A block's windows as arrays: for each its terms from the rarest on, with their offsets, padded to the longest window.

    A window of which the documents lack a term cannot be a phrase; it is kept with the
    terms that they have if ``slop`` asks for proximity, which takes two.
    """

    def __init__(self, windows: list, often: dict[int, int], slop: int):
        rows = []
        for w in windows:
            known = sorted((k for k, t in enumerate(w.terms) if t in often), key=lambda k: (often[w.terms[k]], k))  # ties: the first
            if len(known) == len(w.terms) or slop and len(known) > 1:
                rows.append((w.win, len(w.terms), len(known), [w.terms[k] for k in known], known))
        width = max((len(r[4]) for r in rows), default=0)
        self.wins = np.array([r[0] for r in rows], np.int64)
        self.length, self.known = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        self.terms, self.offsets = np.zeros((len(rows), width), np.uint64), np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            self.terms[i, : len(r[3])] = np.array(r[3], np.int64).view(np.uint64)
            self.offsets[i, : len(r[4])] = r[4]


def looked_up(row: dict, plan: Plan, slop: int) -> tuple[np.ndarray, ...]:
    """(document of the segment, window, start in the document, exact) of a segment's matches."""
    terms, counts = np.cumsum(restored(row["terms"], np.uint64)), restored(row["counts"], np.uint32).astype(np.int64)
    first = np.cumsum(counts) - counts
    at, inside = held(terms, plan.terms[:, 0])
    lists = np.zeros(len(at), np.int64)
    lists[inside] = counts[at[inside]]
    win = np.repeat(np.arange(len(plan.wins)), lists)
    if not len(win):
        return (np.empty(0, np.int64),) * 4
    steps = restored(row["places"], np.uint32).astype(np.int64)
    total = np.cumsum(steps)
    places = total - np.repeat(total[first] - steps[first], counts)
    listed = np.repeat(np.arange(len(terms)), counts) << 32 | places  # in order, so that a search tells what a list holds
    lengths = restored(row["lengths"], np.uint32).astype(np.int64)
    ends = np.cumsum(lengths)
    nth = np.arange(len(win)) - np.repeat(np.cumsum(lists) - lists, lists)
    place = places[first[at[win]] + nth]
    doc = np.searchsorted(ends, place, "right")
    begin = (ends - lengths)[doc]
    start = place - plan.offsets[win, 0]

    def there(which: np.ndarray, column: int, by: int = 0) -> np.ndarray:
        """Whether the list of each window's term in ``column`` has its place, adjusted by the offset, in the same document."""
        spot = start[which] + plan.offsets[win[which], column] + by
        number, known = held(terms, plan.terms[win[which], column])
        wanted = np.where(known, number, 0) << 32 | np.maximum(spot, 0)
        near = np.minimum(np.searchsorted(listed, wanted), len(listed) - 1)
        return known & (spot >= begin[which]) & (spot < ends[doc[which]]) & (listed[near] == wanted)

    everything = np.arange(len(win))
    second = np.minimum(1, plan.known[win] - 1)  # a window of one term is its own second
    straight = np.where(second == 1, there(everything, 1), True) if plan.terms.shape[1] > 1 else np.ones(len(win), bool)
    kept = straight.copy()
    for by in (b for b in range(-slop, slop + 1) if b):
        if plan.terms.shape[1] > 1:
            kept |= np.where(second == 1, there(everything, 1, by), False)
        alone = np.flatnonzero(second == 0)
        kept[alone] |= there(alone, 0, by)
    exact = straight & (plan.known[win] == plan.length[win]) & (start >= begin) & (start + plan.length[win] <= ends[doc])
    for column in range(2, plan.terms.shape[1]):
        left = np.flatnonzero(exact & (plan.length[win] > column))
        exact[left] = there(left, column)
    return doc[kept], plan.wins[win[kept]], (start - begin)[kept], exact[kept]


def matched(plan: Plan, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc, win, start, exact = looked_up(row, plan, slop)
                if len(doc):
                    keys = restored(row["docs"], np.int64)[doc]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(win), pa.array(start.astype(np.int32)), pa.array(exact)], ["_id", "win", "start", "exact"])

    return run


def block_matches(index: DataFrame, windows: list, slop: int) -> DataFrame:
    """(_id, win, start, exact) of the windows in the segments of the index."""
    spark = index.sparkSession
    wanted = np.unique(np.array([t for w in windows for t in w.terms], np.int64).view(np.uint64))
    often = {}
    if len(wanted):
        found = index.select("terms", "counts").mapInArrow(counted(wanted), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        often = {r.term: r.n for r in found.collect()}  # at most BLOCK windows' terms
    plan = Plan(windows, often, slop)
    if not len(plan.wins):
        return spark.createDataFrame([], "_id long, win long, start int, exact boolean")
    return index.select("docs", "lengths", "terms", "counts", "places").mapInArrow(matched(plan, slop), "_id long, win long, start int, exact boolean")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, items, n_near, own) of every document.

    Lower-cases A-Z; words are runs of ASCII letters, digits and other characters
    beyond ASCII. ``items`` are the ids, as sorted strings, of items with a window
    that occurs in the document; n_hit counts words inside such occurrences; n_near
    counts starts at which the two rarest terms of a window, among those that the
    documents have at all, stand within ``slop`` words of their distance without an
    exact phrase. Null and empty texts have no words; a null item id is the empty
    string; repeated items count once; an empty benchmark hits nothing. Rows that
    share a doc_id, or have none, are looked up each for itself; own is the hash of
    the text.
    """
    begun = staged()
    rows = texts(docs, id_col, text_col)
    keyed = rows.select(F.xxhash64("_id", "text").alias("key"), "_id", F.xxhash64("text").alias("own"), "text")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    windows = stage(items.mapInArrow(item_windows(window), "item string, win long, terms array<long>"), "items")
    distinct = stage(windows.groupBy("win").agg(F.first("terms").alias("terms")), "windows")
    blocks = max(1, -(-distinct.count() // BLOCK))
    index = stage(keyed.mapInArrow(segments, SEGMENT), "index")  # the only time that the documents are read
    found = None
    for k in range(blocks):  # the benchmark is a stated set of queries, looked up in blocks
        block = distinct.where(F.pmod("win", F.lit(blocks)) == k).select("win", "terms").collect()
        part = stage(block_matches(index, block, slop), "matches")
        found = part if found is None else found.union(part)
    exact = found.where("exact")
    words = exact.join(distinct.select("win", F.size("terms").alias("n")), "win").select("_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place"))
    hit = words.distinct().groupBy("_id").agg(F.count("*").alias("n_hit"))
    holding = exact.select("_id", "win").distinct().join(windows.select("win", "item").distinct(), "win").select("_id", "item").distinct()
    holding = holding.groupBy("_id").agg(F.array_sort(F.collect_list("item")).alias("items"))  # as many as the benchmark has, once each
    near = found.where("NOT exact").groupBy("_id").agg(F.count("*").alias("n_near"))
    judged = stage(hit.join(holding, "_id", "full").join(near, "_id", "full").withColumnRenamed("_id", "key"), "judged")
    documents = index.select("docs", "ids", "owns", "lengths").mapInArrow(sized, "key long, _id long, own long, n_words long").join(judged, "key", "left")
    none = F.array().cast("array<string>")
    out = documents.select(outer_id().alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "own")
    return settled(out, "contamination", begun)


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
held AS (SELECT item, ws[k : k + 9] AS own FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(k) WHERE len(ws) > 0),
wins AS (SELECT own, row_number() OVER () AS win FROM (SELECT DISTINCT own FROM held)),
terms AS (SELECT win, len(own) AS n, generate_subscripts(own, 1) AS k, unnest(own) AS w FROM wins),
place AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM words),
there AS MATERIALIZED (SELECT * FROM place WHERE w IN (SELECT w FROM terms)),
often AS (SELECT w, count(*) AS times FROM there GROUP BY w),
ranked AS (SELECT win, n, k, w, row_number() OVER (PARTITION BY win ORDER BY times, k) AS r, count(*) OVER (PARTITION BY win) AS known FROM terms JOIN often USING (w)),
rare AS (SELECT a.win, a.n, a.w AS wa, a.k AS ka, coalesce(b.w, a.w) AS wb, coalesce(b.k, a.k) AS kb FROM ranked a LEFT JOIN ranked b ON b.win = a.win AND b.r = 2 WHERE a.r = 1 AND (a.known = a.n OR a.known > 1)),
starts AS (
  SELECT p.doc_id, r.win, p.i - r.ka + 1 AS start, bool_or(q.i - p.i = r.kb - r.ka) AS straight
  FROM rare r JOIN there p ON p.w = r.wa JOIN there q ON q.doc_id = p.doc_id AND q.w = r.wb AND q.i BETWEEN p.i + r.kb - r.ka - 2 AND p.i + r.kb - r.ka + 2 GROUP BY ALL),
judged AS (SELECT s.*, len(v.own) AS n, straight AND start >= 1 AND coalesce(d.ws[greatest(start, 1) : greatest(start, 1) + len(v.own) - 1] = v.own, false) AS exact FROM starts s JOIN wins v USING (win) JOIN words d USING (doc_id)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + n)) AS spot FROM judged WHERE exact) GROUP BY doc_id),
found AS (SELECT doc_id, list(item ORDER BY item) AS own FROM (SELECT DISTINCT doc_id, item FROM judged JOIN wins USING (win) JOIN held USING (own) WHERE exact) GROUP BY doc_id),
near AS (SELECT doc_id, count(*) AS n_near FROM judged WHERE NOT exact GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(own), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(own, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""
