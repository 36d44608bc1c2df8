"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text knows
every substring of the sample. A text is parsed greedily into the longest phrases
that the automaton contains; the phrases, normalised by the logarithm of the
sample's length as in the entropy that they estimate, are fewest for its language.
Automata are dense tables, and all segments of a batch of texts step through them
side by side in numpy; a segment that another precedes is parsed again from where
that one ended, until both parses agree, so that every text is parsed as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import inner_id, outer_id, release, slices, stage, staged
from tracemill.shipping import ship

#: Bytes of a text that are parsed side by side with others before their parses are joined.
SEGMENT = 256
#: ASCII: letters folded to lower case by the caller, all else to spaces; other bytes stay.
LETTERS_ONLY = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: bytes) -> bytes:
    """Lower-cased words of letters joined by one space; bytes that are not UTF-8 are left out."""
    return b" ".join(text.decode("utf-8", "ignore").lower().encode().translate(LETTERS_ONLY).split())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions by byte of each state; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


class Parser:
    """The automata of all languages as tables over the byte values of the samples."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        seen = sorted(set(b"".join(samples.values())))
        self.pad, self.width = len(seen) + 1, len(seen) + 2
        self.code = np.zeros(256, np.uint16)
        self.code[seen] = np.arange(1, len(seen) + 1)
        self.tables = [self.table(samples[x]) for x in self.languages]
        self.norms = np.log2([max(2, len(samples[x])) for x in self.languages])

    def table(self, sample: bytes) -> np.ndarray:
        """Next state times the width, or -1; the padding leads to the start. The last state, of bytes that the sample lacks, ends at any byte."""
        step = suffix_automaton(sample)
        out = np.full((len(step) + 1, self.width), -1, np.int32)
        for i, row in enumerate(step):
            if row:
                out[i, self.code[list(row)]] = np.fromiter(row.values(), np.int64, len(row)) * self.width
        out[:, self.pad] = 0
        return out.ravel()

    def phrases(self, found: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        pieces = np.array([-(-len(x) // SEGMENT) for x in found], np.int64)
        flat = np.full(int(pieces.sum()) * SEGMENT, self.pad, np.uint16)
        for at, x in zip((np.cumsum(pieces) - pieces) * SEGMENT, found, strict=True):
            flat[at : at + len(x)] = self.code[np.frombuffer(x, np.uint8)]
        codes = np.ascontiguousarray(flat.reshape(-1, SEGMENT).T).astype(np.int32)
        owner = np.repeat(np.arange(len(found)), pieces)
        after = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # segments that another of their text precedes
        out = np.zeros((len(found), len(self.tables)), np.int64)
        for k, table in enumerate(self.tables):
            out[:, k] = np.bincount(owner, self.starts(table, codes, after), len(found))
        return out

    def starts(self, table: np.ndarray, codes: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Phrases that start inside each segment (columns of ``codes``), each parsed on from the end of the one before."""
        none = len(table) - self.width
        first = np.where(table[: self.width] < 0, none, table[: self.width])
        states, breaks = np.empty(codes.shape, np.int32), np.zeros(codes.shape, bool)
        state = np.full(codes.shape[1], none, np.int32)
        for r, c in enumerate(codes):
            state = table.take(state + c)
            miss = np.flatnonzero(state < 0)
            if len(miss):
                breaks[r, miss] = True
                state[miss] = first.take(c[miss])
            states[r] = state
        again = after
        while len(again):
            left, state, changed = again, states[-1, again - 1].copy(), []
            for r in range(SEGMENT):
                state = table.take(state + codes[r, left])
                miss = state < 0
                state[miss] = first.take(codes[r, left[miss]])
                breaks[r, left] = miss
                apart = state != states[r, left]
                left, state = left[apart], state[apart]
                if not len(left):
                    break
                states[r, left] = state
            else:
                changed = left
            again = np.intersect1d(np.asarray(changed, np.int64) + 1, after)
        return breaks.sum(axis=0)


@lru_cache(maxsize=1)
def parser(samples: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(dict(samples))


def decided(phrases: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language (column) of fewest normalised phrases for each text, and the score.

    A language with as many phrases ties with it, whatever their samples' lengths: these
    tell how well a sample could have known a text, not which language it is of. Then the
    first by name holds, with score 0. With one language alone the score is 1/2.
    """
    counts = phrases * norms
    best = counts.argmin(axis=1)
    alike = phrases == np.take_along_axis(phrases, best[:, None], 1)
    if counts.shape[1] == 1:
        return best, np.full(len(best), 0.5)
    least, second = np.partition(counts, 1, axis=1)[:, :2].T
    return np.where(alike.sum(axis=1) > 1, alike.argmax(axis=1), best), np.where(alike.sum(axis=1) > 1, 0.0, 1.0 - least / np.maximum(second, 1e-9))


def predictions(samples: tuple[tuple[str, bytes], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 4 << 20):
            strings = [x.decode("utf-8", "ignore") for x in raw]
            known = [any(map(str.isalpha, x)) for x in strings]
            names, scores = ["und"] * len(raw), np.zeros(len(raw))
            if samples:
                model = parser(samples)
                choice, told = decided(model.phrases([letters(x) for x in raw]), model.norms)
                scores = np.where(known, told, 0.0)
                names = [model.languages[i] if k else "und" for i, k in zip(choice, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores), batch.column(2), pa.array(known, pa.bool_())], ["_id", "held_out", "lang_pred", "score", "own", "lettered"])

    return run


def level_of(sizes: list[int], budget: int) -> int:
    """The most that each may give so that all together give ``budget``, or everything."""
    left, n = budget, len(sizes)
    for x in sorted(sizes):
        if x * n >= left:
            return left // n
        left, n = left - x, n - 1
    return max(sizes, default=0)


def sample_texts(docs: DataFrame, sample_docs: int, sample_bytes: int) -> tuple[tuple[str, bytes], ...]:
    """At most ``sample_bytes`` of letters of each language, from the ``sample_docs`` documents of least hash, spread as evenly as these allow."""
    begun = staged()
    named = docs.where("NOT held_out AND lang IS NOT NULL AND NOT empty")
    by_hash = Window.partitionBy("lang").orderBy("hash", "_id")
    chosen = stage(named.select("lang", "_id", "hash").withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= sample_docs).select("_id", "hash"), "langid-sample")
    rows = docs.join(F.broadcast(chosen), ["_id", "hash"], "left_semi").where("NOT held_out AND lang IS NOT NULL AND NOT empty")  # sample_docs rows for each language
    sizes: dict[str, list[int]] = {}
    for r in rows.select("lang", F.length("text").alias("size")).collect():
        sizes.setdefault(r.lang, []).append(r["size"])
    share = {k: level_of(v, sample_bytes) for k, v in sizes.items()}
    if not share:
        return ()
    most = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    kept = rows.select("lang", "hash", "_id", F.substring(F.col("text"), F.lit(1), most).alias("text")).orderBy("lang", "hash", "_id").collect()
    out: dict[str, bytes] = {}
    for r in kept:  # sample_bytes characters for each language
        out[r.lang] = (out.get(r.lang, b"") + b" " + letters(r.text.encode()))[:sample_bytes]
    release(docs.sparkSession, begun)
    return tuple(sorted(out.items()))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 96, sample_bytes: int = 49152) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, own, lettered) of every document.

    The model is fitted to a bounded sample: at most ``sample_bytes`` bytes of each
    language, from the ``sample_docs`` documents of least hash among the labelled
    ones whose crc32(doc_id) mod 3 is not 1, each of which gives its beginning, up to
    a length by which all together reach the bound or give all that they have. Every
    text is parsed whole. A null text or one without letters is ``und`` with
    score 0, as is everything if no label can be learned from. A null id is not
    held out. The score is 1 less the ratio of the best to the second normalised
    number of phrases; where another language has as many phrases as the best, that is
    a tie, of which the first by name holds with score 0; with one language alone it is
    1/2. Rows are judged each by itself, so repeated rows agree; own is the hash of the
    text, and lettered tells texts with a letter from those without.
    """
    ship(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(inner_id(id_col).alias("_id"), held.alias("held_out"), text.alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("hash"), (F.length(text) == 0).alias("empty"))
    samples = sample_texts(rows, sample_docs, sample_bytes)
    found = rows.select("_id", "held_out", F.xxhash64("text").alias("own"), "text").mapInArrow(predictions(samples), "_id long, held_out boolean, lang_pred string, score double, own long, lettered boolean")
    return found.select(outer_id().alias("doc_id"), "held_out", "lang_pred", "score", "own", "lettered")
