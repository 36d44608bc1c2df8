"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of words; the index holds the
blocks, and every rolling window of that length probes it. A window of 13 words
contains a whole block of 7 wherever the grid lies, so each repeat makes a hit.
Hits are extended: the 13-word windows around them, in the document that holds
the block and in the one that probed it, are compared by their own hashes, and a
chain of equal windows is a maximal exact repeat. Both exchanges deal entries by
hash into buckets, packed per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracemill.llm.common import PACKED, WordHashes, buckets_for, dealt, gathered, gram_hashes, grouped_positions, outer_id, per_document, positions, row_keys, slices, texts

WINDOW = 13
#: Entries that a bucket gets; the number of buckets grows with the corpus.
PER_BUCKET = 1_000_000
POSITIONS = "_id long, pos binary"


def in_order(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers that sort as the documents do, by id and then by key."""
    if np.array_equal(ids, keys):
        return ids
    at = np.lexsort((keys, ids))
    new = np.concatenate(([True], (ids[at][1:] != ids[at][:-1]) | (keys[at][1:] != keys[at][:-1])))
    out = np.empty(len(ids), np.int64)
    out[at] = np.cumsum(new)
    return out


def met(ids: np.ndarray, indexed: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries meet their counterpart, and which stand for all of their hash.

    A probe meets a block of a smaller document, a block is met by the probe of a
    larger one; so of a hash the smallest block and the largest probe tell all.
    """
    _, key = np.unique(hashes, return_inverse=True)
    n = int(key.max(initial=-1)) + 1
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, key[indexed], ids[indexed])
    np.maximum.at(most, key, ids)
    least, most = least[key], most[key]
    return (ids > least) | (indexed & (ids < most)), (indexed & (ids == least)) | (ids == most)


SETTLED = f"{PACKED}, pos binary, _id long"


def with_settled(dealt_out: pa.RecordBatch, ids: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries for the buckets, and beside them the places on which a task has decided itself."""
    n = dealt_out.num_rows
    yield dealt_out.append_column("pos", pa.nulls(n, pa.binary())).append_column("_id", pa.nulls(n, pa.int64()))
    settled = grouped_positions(ids, places)
    n = settled.num_rows
    bucket = pa.array((settled.column(0).to_numpy() % buckets).astype(np.int32))
    yield pa.RecordBatch.from_arrays([bucket, *[pa.nulls(n, pa.binary())] * 4, settled.column(1), settled.column(0)], [x.split()[0] for x in SETTLED.split(", ")])


def taken_apart(group: pa.Table) -> tuple[pa.Table, pa.Table]:
    """What was settled before, and the entries."""
    done = pc.is_valid(group.column("pos"))
    return group.filter(done).select(["_id", "pos"]), group.filter(pc.invert(done))


def probes(block: int, buckets: int):
    """All rolling windows of a batch; those at multiples of ``block`` are the indexed blocks.

    Of a hash that many documents of the batch share, only what other batches must
    know goes on, so a passage of very many documents never gathers in one bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch, found in slices(batches):
            grams = [gram_hashes(memo.of(x.split()), block) for x in found]
            n = np.array([len(x) for x in grams], np.int64)
            if n.sum():
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                keys, ids, hashes = np.repeat(batch.column(0).to_numpy(), n), np.repeat(batch.column(1).to_numpy(), n), np.concatenate(grams)
                done, tells = met(in_order(ids, keys), place % block == 0, hashes)
                sent = ~done | tells
                yield from with_settled(dealt(keys[sent], place[sent], hashes[sent], buckets, exact=False, named=ids[sent]), keys[~sent], place[~sent], buckets)

    return run


def hit(block: int):
    """Places where a probe meets a block of a smaller document, or a block is met by a larger one's probe."""

    def run(group: pa.Table) -> pa.Table:
        settled, group = taken_apart(group)
        if not group.num_rows:
            return settled
        keys, places, hashes, ids = gathered(group, exact=False, named=True)
        done, _ = met(in_order(ids, keys), places % block == 0, hashes)
        return pa.concat_tables([settled, pa.Table.from_batches([grouped_positions(keys[done], places[done])])])

    return run


def later_ones(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which entries have a hash that a smaller document has, too."""
    _, key = np.unique(hashes, return_inverse=True)
    least = np.full(int(key.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, key, ids)
    return ids > least[key]


def extended(window: int, block: int, buckets: int):
    """Hashes of the windows around hits. Of equal windows in a batch only the first document's go on; the rest are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch, found in slices(batches):
            keys, ids, places, hashes = [], [], [], []
            for key, doc, hits, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column("pos").to_pylist(), found, strict=True):
                words = memo.of(text.split())
                n = len(words) - window + 1
                if n <= 0:
                    continue
                at = positions(hits)
                around = np.zeros(n + 1, np.int64)
                np.add.at(around, np.clip(at - (window - block), 0, n), 1)
                np.add.at(around, np.clip(at + 1, 0, n), -1)
                some = np.flatnonzero(np.cumsum(around[:n]) > 0)
                hashes.append(gram_hashes(words, window)[some])
                places.append(some)
                keys.append(np.full(len(some), key, np.int64))
                ids.append(np.full(len(some), doc, np.int64))
            if not ids:
                continue
            keys, ids, places, hashes = map(np.concatenate, (keys, ids, places, hashes))
            later = later_ones(in_order(ids, keys), hashes)
            yield from with_settled(dealt(keys[~later], places[~later], hashes[~later], buckets, named=ids[~later]), keys[later], places[later], buckets)

    return run


def repeated(group: pa.Table) -> pa.Table:
    """Places of windows that also start in a smaller document."""
    settled, group = taken_apart(group)
    if not group.num_rows:
        return settled
    keys, places, hashes, ids = gathered(group, named=True)
    later = later_ones(in_order(ids, keys), hashes)
    return pa.concat_tables([settled, pa.Table.from_batches([grouped_positions(keys[later], places[later])])])


def trimmed(window: int):
    """Each document without the words that its repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches):
            n, gone, kept = [], [], []
            for starts, text in zip(batch.column("pos").to_pylist(), found, strict=True):
                words = text.split()
                cover = np.zeros(len(words) + 1, np.int64)
                at = positions(starts)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                stays = np.cumsum(cover[:-1]) == 0
                n.append(len(words))
                gone.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(words if not gone[-1] else [words[i] for i in np.flatnonzero(stays)]))
            digests = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept]), pa.array(digests)], ["_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) of every document.

    Words are runs without ASCII white space. A word goes if a window of ``window``
    words around it also starts in a document of smaller id; windows are judged on
    the input. Texts of fewer words, null and empty ones lose nothing. A null id is
    smaller than any other. Rows that repeat id and text are one document and lose
    the same; rows that repeat an id, or have none, with other text are documents of
    their own, in the order of a hash. kept_text joins the kept words by one space.
    """
    block = (window + 1) // 2
    rows = row_keys(texts(docs, id_col, text_col))
    buckets = buckets_for(rows, "text", PER_BUCKET, 6.0)
    by_key = lambda found: per_document(found).withColumnRenamed("_id", "key")
    hits = rows.select("key", "_id", "text").mapInArrow(probes(block, buckets), SETTLED).groupBy("bucket").applyInArrow(hit(block), POSITIONS)
    placed = rows.repartition("key")
    around = placed.join(by_key(hits), "key").select("key", "_id", "pos", "text")
    found = around.mapInArrow(extended(window, block, buckets), SETTLED).groupBy("bucket").applyInArrow(repeated, POSITIONS)
    result = placed.join(by_key(found), "key", "left").select("_id", "pos", "text").mapInArrow(trimmed(window), "_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return result.select(outer_id().alias("doc_id"), "n_words", "n_removed", "kept_text", "kept_sha256")


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS MATERIALIZED (SELECT doc_id, k, md5(array_to_string(ws[k : k + 12], ' ')) AS win FROM words, unnest(range(1, len(ws) - 11)) t(k)),
firsts AS (SELECT win, min(doc_id) AS first FROM wins GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS i FROM wins JOIN firsts USING (win) WHERE first < doc_id),
word AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM words),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS rest FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
