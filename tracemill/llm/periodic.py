"""Periodic runs of words by multi-scale minimizers.

A run of period q repeats the words of its first q words. Periods below SHORTEST
are found by direct scans: words q apart are compared along the whole text. For
longer ones there is a scale for each power of two s up to the period: of every s
consecutive hashes of s words the least are kept as minimizers, and since a window
inside a run has the same content as the one a period later, two equal minimizers
stand q apart in every run with s <= q < 2 s. Such pairs are seeds that are
compared and extended word by word to the maximal stretch. Words of s that lie in a
run of period s / 3 or less cannot be minimizers: such runs are known from smaller
scales, and without them equal minimizers stand over s / 3 apart, so that a
minimizer has at most six partners and no text makes pairs with the square of its
length. All texts of a batch are scanned side by side.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import NO_ID, mixed, outer_id, slices, texts

#: Periods below this one are scanned directly; the first scale.
SHORTEST = 16
LEAST_LENGTH, LEAST_EXPONENT = 24, 3
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
FOUND = "_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, own long"


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, of which one in ten ids is made periodic from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
    return edges[::2], edges[1::2]


def window_least(values: np.ndarray, w: int, best=np.minimum, fill=NEVER) -> np.ndarray:
    """The least (or what ``best`` takes) of each w values from a position on, the text padded by ``fill``; two passes over blocks of w."""
    n = len(values)
    padded = np.full((n // w + 2) * w, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[w - 1 : w - 1 + n])


class Scan:
    """The runs of many texts whose word numbers stand one after another.

    ``ends`` has for each place the end of its text. Runs are (start, end, period)
    with end - start >= least_exponent * period, in ascending order of period; those
    whose words have a smaller period are left out.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, least_exponent: int):
        self.ids, self.lengths, self.exponent = ids, lengths, least_exponent
        first = np.cumsum(lengths) - lengths
        self.ends = np.repeat(first + lengths, lengths)
        self.begins = np.repeat(first, lengths)
        self.runs: dict[tuple[int, int], int] = {}

    def add(self, start: int, end: int, period: int) -> None:
        """``start`` to ``end`` is maximal for ``period``; a smaller period of the same stretch was found before."""
        if end - start >= self.exponent * period:
            self.runs.setdefault((start, end), period)

    def short(self, upto: int, least: int) -> None:
        """All periods up to ``upto`` by comparing words at that distance; stretches of ``least`` words or more."""
        place = np.arange(len(self.ids))
        for q in range(1, min(upto, int(self.lengths.max(initial=0)) // self.exponent) + 1):
            same = (self.ids[q:] == self.ids[:-q]) & (place[q:] < self.ends[:-q])
            a, b = stretches(same)
            long = (b - a + q) >= max(least, self.exponent * q)
            for i, j in zip(a[long].tolist(), b[long].tolist(), strict=True):
                self.add(i, j + q, q)

    def scale(self, s: int, hashes: np.ndarray) -> None:
        """Periods from s to 2 s - 1, from equal minimizers of s words; ``hashes`` are those of s words from each place on."""
        hashes = hashes.copy()
        hashes[np.arange(len(hashes)) + s > self.ends] = NEVER
        flat = np.zeros(len(hashes) + 1, np.int64)
        for (a, b), q in self.runs.items():
            if 3 * q <= s <= b - a:  # words of s that repeat within themselves
                flat[a] += 1
                flat[b - s + 1] -= 1
        hashes[np.cumsum(flat[:-1]) > 0] = NEVER
        least = window_least(hashes, s)
        # a place is a minimizer if it is least in some window that holds it: the greatest of its windows' least
        upto = window_least(least[::-1], s, np.maximum, np.uint64(0))[::-1]
        at = np.flatnonzero((upto == hashes) & (hashes != NEVER))
        at = at[np.argsort(hashes[at], kind="stable")]
        own, text = hashes[at], self.begins[at]
        pairs, k = [], 1
        while k < len(at):  # six rounds at most, unless hashes collide
            apart = at[k:] - at[:-k]
            alike = (own[k:] == own[:-k]) & (text[k:] == text[:-k])
            seeds = np.flatnonzero(alike & (apart >= s) & (apart < 2 * s))
            pairs.append(np.stack([apart[seeds], at[seeds]]))
            if not (alike & (apart < 2 * s)).any():
                break
            k += 1
        if not pairs:
            return
        apart, where = np.concatenate(pairs, axis=1)
        order = np.lexsort((where, apart))
        period, done = 0, -1
        for q, p in zip(apart[order].tolist(), where[order].tolist(), strict=True):
            if q != period:
                period, done = q, -1
            if p >= done:  # else the stretch that holds it is known
                a, done = self.extended(p, q)
                if done > p:
                    self.add(a, done + q, q)

    def extended(self, p: int, q: int) -> tuple[int, int]:
        """The maximal stretch around p of words that equal those q later."""
        first, last = int(self.begins[p]), int(self.ends[p]) - q
        end, step = p, 64
        while end < last:
            more = min(step, last - end)
            differ = np.flatnonzero(self.ids[end : end + more] != self.ids[end + q : end + q + more])
            if len(differ):
                end += int(differ[0])
                break
            end, step = end + more, step * 2
        start, step = p, 64
        while start > first:
            more = min(step, start - first)
            differ = np.flatnonzero(self.ids[start - more : start] != self.ids[start - more + q : start + q])
            if len(differ):
                start += int(differ[-1]) + 1 - more
                break
            start, step = start - more, step * 2
        return start, end

    def all_runs(self, least: int) -> list[tuple[int, int, int]]:
        if not len(self.ids):
            return []
        self.short(SHORTEST - 1, min(least, SHORTEST))
        s, hashes = 1, mixed(self.ids.astype(np.uint64) + np.uint64(1))
        longest = int(self.lengths.max(initial=0))
        while s * self.exponent <= longest:
            if s >= SHORTEST:
                self.scale(s, hashes)
            later = np.zeros_like(hashes)
            later[:-s] = hashes[s:]
            hashes = mixed(hashes * np.uint64(0xD6E8FEB86659FD93) + later)
            s *= 2
        return sorted((a, b, q) for (a, b), q in self.runs.items() if b - a >= least)


def periodic_runs(found: list[list[bytes]], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then period.

    ``least_exponent`` of 3 or more: it is what makes a window of a run repeat inside it.
    """
    if least_exponent < 3:
        raise ValueError("runs shorter than three periods cannot be found by minimizers of their scale")
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(x) for x in found], np.int64)
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for x in found for w in x), np.int64, int(lengths.sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in found]
    # texts of like length are scanned together, so that large scales pass over long texts alone
    group = np.where(lengths > 0, np.log2(np.maximum(lengths, 1)).astype(np.int64) // 2, -1)
    of_word = np.repeat(group, lengths)
    for g in np.unique(group[group >= 0]):
        own = np.flatnonzero(group == g)
        place = np.cumsum(lengths[own]) - lengths[own]
        for a, b, q in Scan(ids[of_word == g], lengths[own], least_exponent).all_runs(least_length):
            k = int(np.searchsorted(place, a, "right")) - 1
            out[own[k]].append((a - int(place[k]), b - a, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not inside]


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of most periods; ties: the smallest start, then period."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def scanned(least_length: int, least_exponent: int, plant: bool, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), *[pa.string()] * keep)
        names = [x.split()[0] for x in FOUND.split(", ")] + ["kept_text"] * keep
        for batch, raw in slices(batches):
            ids = batch.column(0).to_pylist()
            words = [x.split() for x in raw]
            if plant:
                words = [planted(w, None if i == NO_ID else i) for i, w in zip(ids, words, strict=True)]
            rows = []
            for i, own, w, runs in zip(ids, batch.column(1).to_pylist(), words, periodic_runs(words, least_length, least_exponent), strict=True):
                best = greatest(runs) if runs else None
                told = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
                kept = b" ".join(collapsed(w, runs))
                most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((i, len(runs), *most, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), own, *[kept.decode("utf-8", "replace")] * keep))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, plant: bool = False, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, own[, kept_text]) of every row.

    Words are the runs without ASCII white space. A run is a maximal stretch of words
    of smallest period q with ``least_length`` and ``least_exponent`` * q words at
    least. start, length and period are those of the run with the most periods, null
    without one. The collapsed text is that without the words that a run holds after
    its first period. ``plant`` makes one in ten texts periodic by the id's crc32
    first (a null id never). Null and empty texts have no words and no runs. Rows are
    judged each by itself; own is the hash of the text.
    """
    rows = texts(docs, id_col, text_col).select("_id", F.xxhash64("text").alias("own"), "text")
    found = rows.mapInArrow(scanned(least_length, least_exponent, plant, keep_text), FOUND + ", kept_text string" * keep_text)
    return found.select(outer_id().alias("doc_id"), *found.columns[1:])


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')], lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT FOR k IN range(8)], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) AS h
  FROM documents),
cut AS (SELECT doc_id, ws, len(ws)::BIGINT AS n, h % 10 = 0 AND len(ws) > 0 AS planted, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 % 8 AS e FROM doc),
made AS (SELECT doc_id, n, CASE WHEN planted THEN [ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + e)) END + 1] FOR i IN range(n)] ELSE ws END AS ws FROM cut),
word AS MATERIALIZED (SELECT doc_id, n, generate_subscripts(ws, 1)::BIGINT - 1 AS i, unnest(ws) AS w FROM made),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM word x JOIN word y ON y.doc_id = x.doc_id AND y.w = x.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
run AS (SELECT doc_id, start, length, min(q) AS period FROM island GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS r FROM run),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM made LEFT JOIN told USING (doc_id) LEFT JOIN (FROM best WHERE r = 1) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
