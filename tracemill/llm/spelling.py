"""Grouping spelling variants by dynamic programming over sorted vocabularies.

A sorted vocabulary is scanned as words that share prefixes: the banded row of the
edit matrix that belongs to a prefix is computed once for all words that start with
it, which the common prefixes of neighbours (LCPs) tell, and a range of words whose
shared prefix is over one edit away from a word is skipped as a whole. Words are
one edit apart if they agree before the middle or after it, so the vocabulary is
sorted twice, forward for edits in the second half and backward for the rest, and
a scan starts at the range that shares a word's unedited half. Sorted lists are cut
into segments of bounded size; the same scan over what the words of a segment share
tells to which segments a word must be sent.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import NO_ID, release, settled, slices, stage, staged, texts

RUN = re.compile("[a-zÀ-ÿ]+")
#: Letters of a word, at least, and occurrences.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One in so many runs of a document loses a letter if the vocabulary is to be given misspellings.
PLANTED = 97
#: Words that a segment of a sorted list holds, about.
SEGMENT = 1 << 14
#: Code points of a segment's first and last word by which it is known; what it shares beyond them is not used.
BOUND = 64
#: Above every code point of a word.
LAST = "\U0010ffff"
FAR = 2


def common(a: str, b: str) -> str:
    """The prefix that two words share."""
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:k]


class Codes:
    """Words as code points one after another."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer("".join(words).encode("utf-32-le") + b"\0" * 4, np.uint32)

    def at(self, word: np.ndarray, place: int) -> np.ndarray:
        """The code point at ``place`` of each word; 0 beyond its ends."""
        inside = (place >= 0) & (place < self.length[word])
        return np.where(inside, self.flat[np.where(inside, self.start[word] + place, len(self.flat) - 1)], 0)


class SortedWords:
    """A sorted list of distinct words with the LCPs of neighbours."""

    def __init__(self, words: list[str]):
        self.words, self.codes = words, Codes(words)
        self.lcp = np.full(len(words), -1, np.int64)
        left, depth = np.arange(1, len(words)), 0
        while len(left):
            a, b = self.codes.at(left - 1, depth), self.codes.at(left, depth)
            same = (a == b) & (a != 0)
            self.lcp[left[~same]] = depth
            left, depth = left[same], depth + 1

    def range_of(self, prefix: str) -> tuple[int, int]:
        return bisect_left(self.words, prefix), bisect_left(self.words, prefix + LAST)

    def scan(self, queries: list[str], shared: list[int], whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word): words one edit away that begin with the query's first ``shared`` letters; not ``whole``: words that a prefix within one edit could continue.

        All queries go through the list side by side, depth by depth. Each holds ranges of
        words with the row of the edit matrix of their shared prefix: the distances to the
        query's prefixes one letter shorter, of the same length and one letter longer.
        """
        told, own = Codes(queries), self.codes
        begin = defaultdict(list)
        for k, (q, d) in enumerate(zip(queries, shared, strict=True)):
            a, b = self.range_of(q[:d])
            if a < b:
                begin[d].append((k, a, b))
        empty = np.empty(0, np.int64)
        q, lo, hi, less, same, more = (empty,) * 6
        hits, depth = [], 0
        waiting = sorted(begin, reverse=True)
        while len(q) or waiting:
            if not len(q):
                depth = max(depth, waiting[-1])
            if waiting and waiting[-1] == depth:
                k, a, b = np.array(begin[waiting.pop()], np.int64).T
                one = np.ones(len(k), np.int64)
                row = (one if depth else one * FAR, one * 0, np.where(told.length[k] > depth, 1, FAR))
                q, lo, hi, less, same, more = (np.concatenate(x) for x in zip((q, lo, hi, less, same, more), (k, a, b, *row), strict=True))
            ended = own.length[lo] == depth
            if ended.any():
                over = told.length[q] - depth
                distance = np.where(over == 0, same, np.where(over == 1, more, np.where(over == -1, less, FAR)))
                hit = ended & (distance == 1 if whole else np.ones(len(q), bool))
                hits.append(np.stack([q[hit], lo[hit]]))
                lo = lo + ended
                left = lo < hi
                q, lo, hi, less, same, more = (x[left] for x in (q, lo, hi, less, same, more))
            cuts = np.flatnonzero(self.lcp <= depth)
            first, last = np.searchsorted(cuts, lo, "right"), np.searchsorted(cuts, hi, "left")
            children = last - first + 1
            up = np.repeat(np.arange(len(q)), children)
            nth = np.arange(len(up)) - np.repeat(np.cumsum(children) - children, children)
            inner = first[up] + nth
            padded = np.append(cuts, len(self.words))
            start = np.where(nth == 0, lo[up], padded[inner - 1])
            end = np.where(nth == children[up] - 1, hi[up], padded[np.minimum(inner, len(cuts))])
            q, letter, left = q[up], own.at(start, depth), told.length[q[up]] - depth
            a = np.where(left >= 0, np.minimum(less[up] + (told.at(q, depth - 1) != letter), same[up] + 1), FAR)
            b = np.where(left >= 1, np.minimum(np.minimum(same[up] + (told.at(q, depth) != letter), a + 1), more[up] + 1), FAR)
            c = np.where(left >= 2, np.minimum(more[up] + (told.at(q, depth + 1) != letter), b + 1), FAR)
            near = np.minimum(np.minimum(a, b), c) < FAR  # else the range is skipped
            q, lo, hi, less, same, more = (x[near] for x in (q, start, end, a, b, c))
            depth += 1
        found = np.concatenate(hits, axis=1) if hits else np.empty((2, 0), np.int64)
        return found[0], found[1]


def unedited(length: int, backward: bool) -> int:
    """Letters that a word of ``length`` shares at least with one an edit away: before the middle of the shorter one, or backward from its end."""
    return length // 2 if backward else (length - 1) // 2


def ours(a: str, b: str, backward: bool) -> bool:
    """Whether a pair belongs to the forward list or the backward one (in which words are reversed); each to one of them."""
    k = min(len(a), len(b)) // 2
    return a[len(a) - k :] != b[len(b) - k :] if backward else a[:k] == b[:k]


def counted(plant: bool, most: int = 500_000):
    """(word, n): words of each task with their counts, in parts of ``most`` words."""

    def told(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch, raw in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), raw, strict=True):
                name = zlib.crc32(f"{'' if doc == NO_ID else doc}:".encode())
                for word, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                    if len(word) < LEAST_LETTERS:
                        continue
                    if plant and (h := zlib.crc32(word.encode(), name)) % PLANTED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LETTERS:
                            continue
                    total[word] += n
            if len(total) >= most:
                yield told(total)
                total = Counter()
        if total:
            yield told(total)

    return run


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32))], ["key", "n", "segment"])


class Segments:
    """Where the words of a sorted list lie: each segment's first and last word, up to BOUND letters."""

    def __init__(self, bounds: list[tuple[int, str, str]]):
        self.bounds = {s: (lo, hi) for s, lo, hi in bounds}
        self.sharing = defaultdict(list)
        for s, lo, hi in bounds:
            self.sharing[common(lo, hi)].append(s)
        self.prefixes = SortedWords(sorted(self.sharing))

    def of(self, words: list[str], backward: bool) -> tuple[list[int], list[int]]:
        """Pairs of a word's number and a segment that can hold words one edit away."""
        shared = [min(unedited(len(w), backward), BOUND) for w in words]
        who, where = [], []
        deep = [x.tolist() for x in self.prefixes.scan(words, shared, whole=False)]
        for k, p in zip(*deep, strict=True):
            if len(self.prefixes.words[p]) > shared[k]:  # shorter ones are looked up
                who += [k] * len(own := self.sharing[self.prefixes.words[p]])
                where += own
        for k, (w, d) in enumerate(zip(words, shared, strict=True)):
            for n in range(d + 1):
                for s in self.sharing.get(w[:n], ()):
                    lo, hi = self.bounds[s]
                    if hi >= w[:d] and lo <= w[:d] + LAST:
                        who.append(k)
                        where.append(s)
        return who, where


def routed(bounds: list[tuple[int, str, str]], backward: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = None
        for batch in batches:
            segments = segments or Segments(bounds)
            who, where = segments.of(batch.column("key").to_pylist(), backward)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(who, pa.int64())), pa.array(where, pa.int32())], ["key", "segment"])

    return run


def best_of(backward: bool, chunk: int = 8192):
    """(word, n_near, less, form) of the words sent to a segment: how many of its words are near, and the one of largest count as -n and word."""

    def run(members: pa.Table, asking: pa.Table) -> pa.Table:
        members = members.sort_by("key")
        held, counts = members.column("key").to_pylist(), members.column("n").to_numpy()
        turned = (lambda w: w[::-1]) if backward else str
        rank = np.empty(len(held), np.int64)
        rank[sorted(range(len(held)), key=lambda i: turned(held[i]))] = np.arange(len(held))
        scan, queries, rows = SortedWords(held), asking.column("key").to_pylist(), []
        for at in range(0, len(queries), chunk):
            own = queries[at : at + chunk]
            q, m = scan.scan(own, [unedited(len(w), backward) for w in own])
            ok = np.fromiter((ours(own[a], held[b], backward) for a, b in zip(q.tolist(), m.tolist(), strict=True)), bool, len(q))
            q, m = q[ok], m[ok]
            order = np.lexsort((rank[m], -counts[m], q))
            q, m = q[order], m[order]
            each, first, times = np.unique(q, return_index=True, return_counts=True)
            rows += [(turned(own[k]), n, -int(counts[m[i]]), turned(held[m[i]])) for k, i, n in zip(each.tolist(), first.tolist(), times.tolist(), strict=True)]
        return pa.table(dict(zip(("word", "n_near", "less", "form"), map(pa.array, zip(*rows, strict=True)), strict=True)) if rows else {"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "less": pa.array([], pa.int64()), "form": pa.array([], pa.string())})

    return run


def near_words(vocabulary: DataFrame, total: int, backward: bool, segment: int) -> DataFrame:
    """Partial rows (word, n_near, less, form) from one of the two sorted lists."""
    name = "backward" if backward else "forward"
    key = F.reverse("word") if backward else F.col("word")
    listed = vocabulary.select(key.alias("key"), "n").repartitionByRange(max(1, -(-total // segment)), "key").sortWithinPartitions("key")
    listed = stage(listed.mapInArrow(numbered, "key string, n long, segment int"), f"sorted-{name}")
    start = F.substring("key", 1, BOUND)
    bounds = [tuple(r) for r in listed.groupBy("segment").agg(F.min(start), F.max(start)).collect()]  # a row for each ``segment`` words
    asking = stage(listed.select("key").mapInArrow(routed(bounds, backward), "key string, segment int"), f"asking-{name}")
    shares = F.ceil(F.count("*") / (4 * segment)).cast("int")  # words that many others resemble are asked for in several tasks
    shares = F.broadcast(stage(asking.groupBy("segment").agg(shares.alias("shares")), f"shares-{name}"))  # a row a segment
    members = listed.join(shares, "segment").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = asking.join(shares, "segment").withColumn("share", F.pmod(F.xxhash64("key"), "shares").cast("int"))
    return members.select("segment", "share", "key", "n").groupBy("segment", "share").cogroup(dealt.select("segment", "share", "key").groupBy("segment", "share")).applyInArrow(best_of(backward), "word string, n_near long, less long, form string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each round doubles the steps that are followed; counts double at each step, so few rounds are needed."""
    links = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while links.where("moved").limit(1).count():
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stage(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return links.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, segment: int = SEGMENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    Words are the maximal runs of Latin letters (up to U+00FF), lower-cased in ASCII,
    of LEAST_LETTERS code points and LEAST_COUNT occurrences at least. A word's form is
    the one of largest count among those one edit away (ties: the first by code point),
    if that is twice its own; its root is the last that is reached by following forms.
    ``plant`` deletes a letter of one run of a document in PLANTED, chosen by the crc32
    of ``<id>:<run>`` (a null id is empty). Null and empty texts have no words; rows
    that repeat count as often; an empty table, or one without such words, gives no rows.
    """
    begun = staged()
    found = texts(docs, id_col, text_col).mapInArrow(counted(plant), "word string, n long")
    vocabulary = stage(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "vocabulary")
    total = vocabulary.count()
    near = near_words(vocabulary, total, False, segment).union(near_words(vocabulary, total, True, segment))
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    enough = F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False))
    judged = stage(joined.select("word", F.when(enough, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")), "variants")
    ends = roots(judged.where("form IS NOT NULL"))
    out = judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return settled(out, "spelling", begun)


#: crc32 is spelt out by bytes, as in the SQL of shards; near words share a deletion at one place, or one is a deletion of the other.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT list(list_reduce([n] || [0::BIGINT FOR k IN range(8)], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))) ORDER BY n) AS own FROM (SELECT unnest(range(256))::BIGINT AS n)),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
per AS MATERIALIZED (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS digits FROM run WHERE length(w) >= 5 GROUP BY ALL),
hashed AS (SELECT w, n, xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || [('0x' || substr(digits, 2 * k + 1, 2))::BIGINT FOR k IN range(length(digits) // 2)], lambda c, b: xor(c >> 8, own[xor(c & 255, b) + 1]))) AS h FROM per, bits),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
voc AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
del AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM voc)),
pair AS (
  SELECT DISTINCT a.word, b.word AS other FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM del WHERE rest IN (SELECT word FROM voc) UNION SELECT rest, word FROM del WHERE rest IN (SELECT word FROM voc)),
best AS (SELECT pair.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS form, max(v.n) AS form_n FROM pair JOIN voc v ON v.word = other GROUP BY pair.word),
judged AS MATERIALIZED (SELECT word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM voc LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM voc UNION ALL SELECT walk.word, form FROM walk JOIN judged ON judged.word = walk.at WHERE form IS NOT NULL)
SELECT j.word, j.form, walk.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN walk USING (word) JOIN judged e ON e.word = walk.at AND e.form IS NULL
"""
