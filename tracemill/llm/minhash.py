"""Near-duplicates by b-bit MinHash.

Documents with equal shingle sets are one node. Bands of minima give candidates:
nodes that share a bucket. Each is first held against the smallest node of its
bucket by its packed 4-bit minima, whose bit counts estimate the similarity,
corrected for chance collisions; the others of a bucket meet those alone that are
unlike its smallest node, by signature, too. What the estimates connect is a family,
and only families' full sets are moved and compared. A family larger than a block
is thinned first: each node is confirmed against its most likely partner, and only
if that leaves it in several pieces are they compared, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import NO_ID, WordHashes, gram_hashes, mixed, outer_id, runs, settled, slices, stage, staged, texts
from tracemill.llm.graph import beside, components

SHINGLE, BANDS, ROWS, BITS, BLOCK = 4, 32, 5, 4, 2048
#: Signatures that a task compares with each other at a time.
SIGNATURES = 8192
#: Deviations by which an estimate may fall short of the threshold and still be confirmed.
SPARE = 4.0
LANES = np.uint64(0x1111111111111111)


def multipliers(n: int) -> np.ndarray:
    return (mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, an empty one none."""
    if 0 < len(words) < size:
        return gram_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(gram_hashes(words, size))


def minima(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each factor the least of the set's 32-bit values under that permutation."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 8192):
        np.minimum(out, np.multiply.outer(factors, low[at : at + 8192]).min(axis=1), out=out)
    return out


def pack(least: np.ndarray) -> np.ndarray:
    """The low 4 bits of each minimum, 16 in a 64-bit word."""
    low = (least & np.uint32(15)).astype(np.uint64).reshape(-1, 16)
    return np.bitwise_or.reduce(low << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures ``a`` (n, 1, w) and ``b`` (m, w), less what chance gives."""
    differ = a ^ b
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    differ &= LANES
    share = 1.0 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int32) / (16.0 * b.shape[-1])
    chance = 2.0**-BITS
    return (share - chance) / (1.0 - chance)


def signed(size: int):
    """Signatures of the sets of shingles of ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, factors = WordHashes(), multipliers(BANDS * ROWS)
        for batch, found in slices(batches):
            sizes, keys, packed, bands = [], [], [], []
            for text in found:
                own = shingles(memo.of(text.lower().split()), size)
                least = minima(own, factors)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                packed.append(pack(least).tobytes())
                banded = mixed(gram_rows(least.reshape(BANDS, ROWS)) + np.arange(BANDS, dtype=np.uint64))
                bands.append(banded.astype(np.int64).tolist() if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["_id", "own", "n", "key", "sig", "bands"])

    return run


def gram_rows(rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return total


MEMBER = ["node", "family", "blocks", "sig", "piece"]
SETS = "node long, family long, blocks int, sig binary, piece long, own binary"


def with_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch, found in slices(batches):
            sets = [shingles(memo.of(x.lower().split()), size).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in MEMBER], pa.array(sets, pa.binary())], [*MEMBER, "own"])

    return run


def floor_of(percent: int) -> float:
    """The least estimate of a pair that may reach the threshold."""
    wanted = percent / 100
    return wanted - SPARE * np.sqrt(wanted * (1 - wanted) / (BANDS * ROWS)) / (1 - 2.0**-BITS)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of two sets by which they could reach the threshold."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Signatures of equal length as rows of 64-bit words."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(-1, BANDS * ROWS * BITS // 64)


def likely(percent: int):
    """(a, b, guess): pairs whose signatures may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                guess = estimated(unpacked(batch.column("sig_a")), unpacked(batch.column("sig_b")))
                some = (guess >= floor_of(percent)) & alike(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[some]) for c in ("a", "b")] + [pa.array(guess[some])], ["a", "b", "guess"])

    return run


def rest_of_buckets(percent: int):
    """Likely pairs of buckets' nodes with those unlike the smallest one, as a forest: (a, b, guess)."""

    def run(group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("node").to_numpy(), group.column("part").to_numpy(), group.column("bucket").to_numpy()))
        group = group.take(pa.array(order))
        node, unlike, n, own = (group.column(c).to_numpy() for c in ("node", "unlike", "n", "own_part"))
        bucket, part, packed = group.column("bucket").to_numpy(), group.column("part").to_numpy(), unpacked(group.column("sig"))
        starts = np.union1d(runs(bucket), runs(part)) if len(node) else np.zeros(1, np.int64)
        found: list[tuple[int, int, float]] = []
        for lo, hi in zip(starts, starts[1:], strict=False):
            asks, answers = lo + np.flatnonzero(unlike[lo:hi]), lo + np.flatnonzero(own[lo:hi])
            label = {int(x): -1 for x in node[answers][~unlike[answers]]}  # all of them are like the smallest node
            for i in asks:
                guess = estimated(packed[i][None, :], packed[answers])
                some = answers[(guess >= floor_of(percent)) & alike(n[answers], n[i], percent) & (node[answers] != node[i])]
                near = {}
                for j in some.tolist():
                    near.setdefault(label.get(int(node[j]), int(node[j])), j)
                mine = label.get(int(node[i]), int(node[i]))
                near.pop(mine, None)
                for j in near.values():
                    found.append((int(node[i]), int(node[j]), float(estimated(packed[i][None, :], packed[j][None, :])[0])))
                if near:
                    joined = {mine, *near}
                    least = min(joined)
                    label[int(node[i])] = least
                    label |= {k: least for k, v in label.items() if v in joined} | {x: least for x in joined if x >= 0}
        a, b, guess = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "guess": pa.array(guess, pa.float64())})

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def reached(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(percent: int):
    """Pairs (a, b) of which the full sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("own_a", "own_b"))
            yield batch.select(["a", "b"]).filter(pa.array([reached(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_()))

    return run


def compared(percent: int):
    """Links inside one family, or between two blocks of one, as a forest: (a, b). Nodes of one piece are linked already."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
        side = group.column("block").to_numpy() == group.column("high")[0].as_py()
        order = np.lexsort((ids, side))
        ids, sets, side, packed = ids[order], [sets[i] for i in order], side[order], unpacked(group.column("sig"))[order]
        sizes = np.array([len(x) for x in sets])
        crossing = bool(side.any() and not side.all())
        _, first, label = np.unique(group.column("piece").to_numpy()[order], return_index=True, return_inverse=True)
        label = first[label]
        pairs = []
        for i in range(len(ids) - 1):
            start = max(i + 1, int(np.argmax(side))) if crossing else i + 1
            if crossing and side[i]:
                break
            rest = start + np.flatnonzero(label[start:] != label[i])
            rest = rest[alike(sizes[rest], sizes[i], percent)]
            if not len(rest):
                continue
            guess = estimated(packed[i][None, :], packed[rest])
            for j in rest[guess >= floor_of(percent)][np.argsort(-guess[guess >= floor_of(percent)], kind="stable")]:
                if label[j] != label[i] and reached(sets[i], sets[j], percent):
                    pairs.append((i, j))
                    label[label == label[j]] = label[i]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return run


def likely_links(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, guess): links by estimate that connect whatever shares a bucket and may reach the threshold; few for each node, never all pairs."""
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    total = nodes.count() * BANDS
    star = stage(beside(banded, shared, "bucket", total).where("node <> a").select("a", F.col("node").alias("b"), "bucket", "n"), "minhash-stars")
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    first = star.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    first = stage(first.mapInArrow(likely(percent), "a long, b long, guess double"), "minhash-likely")
    unlike = stage(star.where("n > 2").join(first, ["a", "b"], "left_anti").select("bucket", "b", "n", F.lit(True).alias("unlike")), "minhash-unlike")
    left = unlike.groupBy("bucket").agg(F.max("n").alias("n"))
    among = star.where("n > 2").join(left.select("bucket"), "bucket", "left_semi").select("bucket", "b", "n").join(unlike.drop("n"), ["bucket", "b"], "left")
    parts = F.ceil(F.col("n") / SIGNATURES).cast("int")
    own = F.pmod(F.xxhash64("b"), parts).cast("int")
    every = F.when(F.col("unlike"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    spread = among.withColumn("part", F.explode(every)).select("bucket", "part", F.col("b").alias("node"), F.coalesce("unlike", F.lit(False)).alias("unlike"), (F.col("part") == own).alias("own_part"))
    groups = max(1, unlike.count() // SIGNATURES)
    rows = spread.join(nodes.select("node", "sig", "n"), "node").withColumn("deal", F.pmod(F.xxhash64("bucket", "part"), F.lit(groups)))
    return first.unionByName(rows.groupBy("deal").applyInArrow(rest_of_buckets(percent), "a long, b long, guess double"))


def in_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Links of families by their members' sets, block against block where they have several."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "block", "own", "sig", "piece")
    return dealt.groupBy("family", "low", "high").applyInArrow(compared(percent), "a long, b long")


def confirmed_links(nodes: DataFrame, links: DataFrame, rows: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(a, b): links confirmed on full sets that connect each family as all its links would."""
    families = components(links.select("a", "b"))
    family = families.select("node", F.col("component").alias("family")).union(families.select("component", "component").distinct())
    sized = family.groupBy("family").agg(F.count("*").alias("n"))
    family = beside(family, sized, "family", nodes.count()).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    family = family.join(nodes.select("_id", "own", "node", "sig"), "node").withColumn("piece", F.col("node"))
    family = stage(family, "minhash-families")
    with_text = lambda members: rows.join(members, ["_id", "own"]).select(*MEMBER, "text").mapInArrow(with_sets(shingle), SETS)
    found = in_blocks(with_text(family.where("blocks = 1")), percent)
    large = family.where("blocks > 1")
    if not large.limit(1).count():
        return found
    sets = stage(with_text(large), "minhash-sets")
    best = links.join(large.select(F.col("node").alias("b")), "b", "left_semi").groupBy("b").agg(F.max_by("a", F.struct("guess", -F.col("a"))).alias("a"))
    of = lambda x: sets.select(F.col("node").alias(x), F.col("own").alias(f"own_{x}"))
    sure = stage(best.join(of("a"), "a").join(of("b"), "b").select("a", "b", "own_a", "own_b").mapInArrow(confirmed(percent), "a long, b long"), "minhash-confirmed")
    pieces = large.select("node", "family").join(components(sure), "node", "left").select("node", "family", F.coalesce("component", "node").alias("piece"))
    several = stage(pieces.groupBy("family").agg(F.min("piece").alias("least"), F.max("piece").alias("most")).where("least < most"), "minhash-open")
    left = pieces.join(several.select("family"), "family", "left_semi").select("node", "piece")
    return found.unionByName(sure).unionByName(in_blocks(sets.drop("piece").join(left, "node"), percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, own) of every document.

    Lower-cases A-Z; words are runs without ASCII white space; sets hold distinct
    shingles of ``shingle`` words. Links need ``percent`` of the union. A text of fewer words
    is one shingle; null, empty and blank texts have none and link with nothing,
    so they are kept. Rows of equal sets share a component, of which the smallest
    id is kept. A null id sorts first and is returned as null. Where rows repeat an
    id, or have none, those of other text are documents of their own, in the order
    of own, the hash of the text; those of equal text share the result.
    """
    begun = staged()
    rows = texts(docs, id_col, text_col).select("_id", F.xxhash64("text").alias("own"), "text")
    signatures = stage(rows.mapInArrow(signed(shingle), "_id long, own long, n long, key binary, sig binary, bands array<long>"), "minhash")
    nodes = signatures.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("_id", "own")).alias("least"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    nodes = nodes.select("key", "least._id", "least.own", "bands", "sig", "n").orderBy("_id", "own")
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")  # numbers in that order
    links = stage(likely_links(nodes, percent), "minhash-links")
    joined = components(confirmed_links(nodes, links, rows, percent, shingle))
    roots = nodes.select("key", "node").join(joined, "node", "left").select("key", F.coalesce("component", "node").alias("node"))
    roots = roots.join(nodes.select("node", F.col("_id").alias("root"), F.col("own").alias("root_own")), "node").drop("node")
    result = signatures.select("_id", "own", "n", "key").join(roots, "key", "left")
    root, kept = F.coalesce("root", "_id"), F.coalesce((F.col("_id") == F.col("root")) & (F.col("own") == F.col("root_own")), F.lit(True))
    found = result.select(outer_id().alias("doc_id"), F.col("n").alias("n_shingles"), F.when(root != NO_ID, root).alias("component_id"), kept.alias("kept"), "own")
    return settled(found, "minhash-found", begun)
