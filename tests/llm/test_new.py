"""Periodic runs, spelling variants and shards against plain re-statements."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from cases import DOCS, ordinary

from tracemill.llm import periodic, sharding, spelling


def runs_by_hand(words: list[bytes], least: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """Every lag, every maximal stretch of equal words; of a stretch that several lags give the smallest one's."""
    seen: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in seen.items())


def repetitive(rng: random.Random, letters: int) -> list[bytes]:
    out: list[bytes] = []
    for _ in range(rng.randint(0, 6)):
        unit = [b"a"] * rng.choice([0, 0, 5, 40]) + [rng.choice("abcdefghijkl"[:letters]).encode() for _ in range(rng.choice([1, 2, 3, 7, 15, 16, 17, 20, 31, 33, 64, 90]))]
        out += unit * rng.choice([1, 2, 3, 4, 7])
        if out and rng.random() < 0.3:
            out[rng.randrange(len(out))] = b"zz"
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 12])
def test_runs_of_all_periods(letters):
    rng = random.Random(letters)
    total = long = 0
    for _ in range(60):
        texts = [repetitive(rng, letters) for _ in range(rng.randint(1, 6))]
        want = [runs_by_hand(x) for x in texts]
        assert periodic.periodic_runs(texts) == want
        total, long = total + sum(map(len, want)), long + sum(r[2] >= 2 * periodic.SHORTEST for x in want for r in x)
    assert total > 30 and (letters == 1 or long > 10)


def test_runs_of_fibonacci_words():
    """Many nested runs of many scales, none of which makes pairs without bound."""
    a, b = [b"a"], [b"b"]
    while len(a) < 1500:
        a, b = a + b, a
    found = periodic.periodic_runs([a])[0]
    assert found == runs_by_hand(a) and len({r[2] for r in found}) >= 6


def test_runs_of_documents(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(x.decode() for x in repetitive(rng, 3))) for i in range(80)] + [(None, "x " * 40), (3, None), (90, "")]
    found = {(r.doc_id, r.own): r for r in periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), plant=True, keep_text=True).collect()}
    assert len(found) == len(rows)
    by_id: dict = {}
    for r in found.values():
        by_id.setdefault(r.doc_id, []).append(r)
    changed = 0
    for i, text in rows[:80]:
        words = text.encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            changed += 1
        runs = runs_by_hand(words)
        gone = {k for a, m, q in runs for k in range(a + q, a + m)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        told = "".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        want = (len(runs), *best, milli, hashlib.sha256(told).hexdigest(), hashlib.sha256(kept).hexdigest())
        assert any(tuple(r[1:8]) == want and r.kept_text.encode() == kept for r in by_id[i]), i
    assert changed > 3
    assert by_id[None][0].period == 1 and by_id[None][0].length == 40 and by_id[None][0].kept_text == "x"


def near_by_hand(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("backward", [False, True])
def test_scans_of_segments_find_each_pair_once(backward):
    rng = random.Random(2)
    for letters in ("abc", "abé", "a"):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(150)} | {"x" * 90, "x" * 91})
        listed = sorted(w[::-1] for w in words) if backward else words
        size = rng.randint(1, 40)
        parts = [listed[i : i + size] for i in range(0, len(listed), size)]
        segments = spelling.Segments([(k, x[0][: spelling.BOUND], x[-1][: spelling.BOUND]) for k, x in enumerate(parts)])
        who, where = segments.of(listed, backward)
        assert len(set(zip(who, where, strict=True))) == len(who)
        found = []
        for k, part in enumerate(parts):
            asked = [listed[a] for a, b in zip(who, where, strict=True) if b == k]
            q, m = spelling.SortedWords(part).scan(asked, [spelling.unedited(len(w), backward) for w in asked])
            found += [(asked[a], part[b]) for a, b in zip(q.tolist(), m.tolist(), strict=True)]
        assert all(near_by_hand(a, b) for a, b in found)
        kept = [p for p in found if spelling.ours(*p, backward)]
        want = {(a, b) for a in listed for b in listed if near_by_hand(a, b) and spelling.ours(a, b, backward)}
        assert len(kept) == len(set(kept)) and set(kept) == want


def spelling_by_hand(docs: list[tuple[int | None, str | None]], plant: bool) -> dict[str, tuple]:
    counts: dict[str, int] = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if plant and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in counts if near_by_hand(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w: str) -> str:
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


@pytest.mark.parametrize("segment", [3, 1 << 14])
def test_spelling_variants(spark, segment):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 8))) for _ in range(120)] + ["Ärger", "ärger", "WORDS", "words", "a×b÷c", "aaaaa", "aaaaaa"]
    rows = [(i if i % 9 else None, " ".join(rng.choices(words, weights=[1 + k % 40 for k in range(len(words))], k=80)) if i % 7 else None) for i in range(60)] + [(70, "chain " * 40 + "chains " * 15 + "chainss " * 5)]
    for plant in (False, True):
        found = spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), plant=plant, segment=segment).collect()
        want = spelling_by_hand(rows, plant)
        assert {r.word: tuple(r[1:]) for r in found} == want and len(found) == len(want)
        assert sum(r.root != (r.form or r.word) for r in found) > 0  # some roots are several steps away


def test_spelling_of_one_prefix_and_long_runs(spark):
    """All words share a long prefix, so that most of them lie in each other's range; others are very long."""
    rng = random.Random(5)
    words = ["internation" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(200)] + ["y" * 30_000, "y" * 30_001]
    rows = [(i, " ".join(words[i : i + 100])) for i in range(0, 150)]
    found = spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"), segment=10).collect()
    assert {r.word: tuple(r[1:]) for r in found} == spelling_by_hand(rows, False)


@pytest.mark.parametrize("per_part", [7, 1 << 18])
def test_shards_are_ranges_of_equal_bytes(spark, per_part):
    rows = [(r[0], r[1]) for r in ordinary(n=300)] + [(None, "no id"), (None, "no id"), (7, "again"), (7, None), (400, "")] + [(500, "same")] * 400
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), per_part=per_part).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in found) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    ordered = sorted(found, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    total, largest = sum(r.size for r in found), max(r.size for r in found)
    for k in range(40):
        own = [r for r in ordered if r.shard == k]
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 40) <= largest
    again = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_mix_of_rows_without_ids(spark):
    """300 rows without ids and groups of copies: each source comes near its target, however its rows are dealt."""
    from tracemill.llm import mixing

    rng = random.Random(8)
    rows = [(None, " ".join(["w"] * rng.randint(1, 9)) + f" {i}", f"s{i % 3}") for i in range(300)] + [(None, "a copy of six words here", "s3")] * 200 + [(5, "same id", "s4"), (5, "same id", "s5")] * 30 + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(docs.repartition(5))
    by = {r.src: r for r in found.groupBy("src").agg({"taken": "sum", "size": "max", "target": "max"}).collect()}
    assert len(by) == 7 and all(abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] for r in by.values())
    again = mixing.mix_sources(docs.repartition(2))
    assert found.exceptAll(again).count() == again.exceptAll(found).count() == 0 and found.count() == len(rows)
    assert found.where("taken > 2 * size").count() == 0


def test_languages_by_hand(spark):
    """Label and score of whole texts from greedy phrases by search in the samples; unequal samples, ties, and one language alone."""
    import math

    from pyspark.sql import functions as F

    from tracemill.llm import langid

    rng = random.Random(6)
    speak = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    alphabets = {"aa": "abcdeé", "bb": "bcdfgh", "cc": "xyzü"}
    rows = [(i, speak(alphabets[k], n), k) for i, (k, n) in enumerate([("aa", 400)] * 12 + [("bb", 30)] * 12 + [("cc", 3)] * 6)]
    rows += [(100 + i, speak(rng.choice(list(alphabets.values())), rng.choice([1, 5, 60])), None) for i in range(60)] + [(200, "123 !", "aa"), (None, None, "bb"), (201, "b", None), (202, "BD c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    plain = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), "lang", F.xxhash64("doc_id").alias("hash"), F.coalesce(F.length("text") == 0, F.lit(True)).alias("empty"))
    samples = dict(langid.sample_texts(plain, 96, 49152))
    assert set(samples) == set(alphabets) and len(samples["aa"]) > 10 * len(samples["cc"])

    def phrases(text: bytes, sample: bytes) -> int:
        at = n = 0
        while at < len(text):
            k = 1
            while at + k < len(text) and text[at : at + k + 1] in sample:
                k += 1
            at, n = at + k, n + 1
        return n

    found = {(r.doc_id, r.own): (r.lang_pred, r.score) for r in langid.identify_languages(docs).collect()}
    own = {r.doc_id: r.own for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own")).collect()}
    right = ties = 0
    for i, text, _ in rows:
        pred, score = found[i, own[i]]
        if not any(c.isalpha() for c in text or ""):
            assert (pred, score) == ("und", 0.0)
            continue
        raw = {k: phrases(langid.letters(text.encode()), v) for k, v in samples.items()}
        normal = {k: raw[k] * math.log2(len(samples[k])) for k in samples}
        best = min(sorted(normal), key=normal.get)
        tied = sorted(k for k in raw if raw[k] == raw[best])
        ties += len(tied) > 1
        want = (tied[0], 0.0) if len(tied) > 1 else (best, 1 - normal[best] / sorted(normal.values())[1])
        assert pred == want[0] and abs(score - want[1]) < 1e-9
        right += i is not None and 100 <= i < 200 and set(text) & set(alphabets[pred]) != set()
    assert ties > 0 and right > 50
    alone = langid.identify_languages(docs.where("lang = 'aa'")).where("lang_pred <> 'und'")
    assert {(r.lang_pred, r.score) for r in alone.collect()} == {("aa", 0.5)}


@pytest.mark.parametrize(("block", "slop"), [(7, 2), (50_000, 0), (50_000, 3)])
def test_lookups_of_any_block_on_one_index(spark, monkeypatch, block, slop):
    """Matches by search through all words, whatever the blocks of windows and the segments; the documents are read once."""
    from tracemill.llm import decontaminate

    rng = random.Random(12)
    words = [f"w{k}" for k in range(14)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 9, 60])))) for i in range(40)]
    items = [(k, " ".join(docs[k][1].split()[:12]) if k % 2 else " ".join(rng.choices(words + ["unknown"], k=rng.choice([1, 2, 3])))) for k in range(24)]
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    reads = []
    stage = decontaminate.stage
    monkeypatch.setattr(decontaminate, "stage", lambda df, name: reads.append(name) or stage(df, name))
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window=4, slop=slop).collect()
    assert reads.count("index") == 1 and (block > 7 or reads.count("matches") > 1)
    often: dict[str, int] = {}
    for _, t in docs:
        for w in t.split():
            often[w] = often.get(w, 0) + 1
    windows = {tuple(ws[k : k + 4]) for ws in (t.split() for _, t in items) for k in range(max(1, len(ws) - 3)) if ws}
    for r in found:
        own = docs[r.doc_id][1].split()
        hit, near = set(), 0
        for win in windows:
            exact = {k for k in range(len(own)) if tuple(own[k : k + len(win)]) == win}
            hit |= {k + j for k in exact for j in range(len(win))}
            known = sorted((k for k, t in enumerate(win) if t in often), key=lambda k: (often[win[k]], k))
            if len(known) == len(win) or slop and len(known) > 1:
                a, b = known[0], known[min(1, len(known) - 1)]
                starts = {p - a for p, w in enumerate(own) if w == win[a] and any(0 <= p + b - a + by < len(own) and own[p + b - a + by] == win[b] for by in range(-slop, slop + 1))}
                near += len(starts - exact)
        assert (r.n_words, r.n_hit, r.n_near) == (len(own), len(hit), near if slop else r.n_near)
