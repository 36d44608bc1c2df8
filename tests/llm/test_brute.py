"""Operators that SQL cannot express, against plain re-statements of their contracts."""

from __future__ import annotations

import brute
import brute_lm
import pytest
from cases import DOCS, at_the_edges, ordinary, sentence

from tracemill.llm import block_dedup, decontaminate, license_scan, minhash, ngram_lm, suffix_dedup


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def got(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def whole_edges():
    """Edge rows with one row for each id that is not null."""
    return list({r[0]: r for r in at_the_edges() if r[0] is not None}.values())


@pytest.mark.parametrize("seed", [3, 4])
def test_block_dedup(spark, seed):
    rows = ordinary(seed) + [(100 + i, *r[1:]) for i, r in enumerate(whole_edges())]
    found = block_dedup.remove_repeats(spark.createDataFrame(rows, DOCS))
    assert got(found, "n_words", "n_removed", "kept_sha256") == brute.block_dedup(pairs(rows))


@pytest.mark.parametrize(("seed", "common"), [(3, 2000), (4, 2000), (3, 2), (4, 5)])  # with few places, grams count as common
def test_suffix_dedup(spark, seed, common):
    rows = ordinary(seed) + [(100 + i, *r[1:]) for i, r in enumerate(whole_edges())] + [(200, "abc" * 90, "", "", 0), (201, "x" * 250, "", "", 0), (202, "x" * 99, "", "", 0), (203, "y" + "x" * 100, "", "", 0)]
    found = suffix_dedup.remove_repeated_spans(spark.createDataFrame(rows, DOCS), common=common)
    assert got(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_dedup(pairs(rows))


def test_near_duplicates(spark, monkeypatch):
    rows = ordinary(5, 90) + [(100 + i, *r[1:]) for i, r in enumerate(whole_edges())]
    want = brute.near(pairs(rows))
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, DOCS)), "n_shingles", "component_id", "kept") == want
    monkeypatch.setattr(minhash, "BLOCK", 2)  # families dealt over many blocks
    monkeypatch.setattr(minhash, "SIGNATURES", 2)
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, DOCS)), "n_shingles", "component_id", "kept") == want


def test_near_duplicates_of_a_template(spark, monkeypatch):
    """A chain of edits and a template whose fillings are often unlike: buckets' smallest nodes do not stand for the others."""
    import random

    rng = random.Random(21)
    base, rows = sentence(rng, 60).split(" "), []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 4, 5])):
            words[at] = f"q{rng.randrange(3)}{at}"
        rows.append((i, " ".join(words), "en", "a", 1))
    chain = sentence(rng, 80).split(" ")
    for i in range(40):
        chain[rng.randrange(80)] = f"z{i}"
        rows.append((200 + i, " ".join(chain), "en", "a", 1))
    want = brute.near(pairs(rows))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert len({x[1] for x in want.values()}) > 3
    for block in (2048, 16):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert got(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == want


def test_components_with_a_hot_centre(spark, monkeypatch):
    """A star, a path and pairs; the star's centre has most links."""
    from tracemill.llm import graph
    from tracemill.llm.graph import components

    monkeypatch.setattr(graph, "LEAST", 50)
    links = [(0, k) for k in range(1000, 1600)] + [(k, k + 1) for k in range(1, 12)] + [(5000 + 2 * k, 5001 + 2 * k) for k in range(50)] + [(11, 1200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in [*range(1000, 1600), *range(1, 13)]) and all(found[5001 + 2 * k] == 5000 + 2 * k for k in range(50)) and len(found) == 662


def test_estimate_is_corrected_for_chance():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = (minhash.pack(rng.integers(0, 1 << 32, 160, dtype=np.uint32)) for _ in range(2))
    assert minhash.estimated(a, a[None])[0] == 1.0
    assert abs(minhash.estimated(a, b[None])[0]) < 0.15


def test_contamination(spark, monkeypatch):
    import random

    rng = random.Random(2)
    items = [(i, sentence(rng, n)) for i, n in enumerate([0, 1, 4, 9, 10, 11, 40])] + [(7, None), (8, "!!")]
    rows = [(i, f"{sentence(rng, 4)} {rng.choice(items)[1] or ''} {sentence(rng, 6)}".upper() if i % 3 else sentence(rng, 30), "", "", 0) for i in range(40)]
    rows += [(100 + i, *r[1:]) for i, r in enumerate(whole_edges())]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(pairs(rows), items)
    for block in (50_000, 7):  # one block of windows, and several
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        found = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"]).encode()), r.n_hit > 0) for r in decontaminate.find_contamination(docs, bench).collect()}
        assert found == want


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two unheard three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta", "", "", 0), (2, "alpha x beta gamma delta", "", "", 0), (3, "delta alone", "", "", 0), (4, "one two other three", "", "", 0), (5, "three", "", "", 0)], DOCS)
    found = {r.doc_id: (r.n_hit, r.n_near > 0) for r in decontaminate.find_contamination(docs, bench, slop=1).collect()}
    assert found == {1: (4, False), 2: (0, True), 3: (0, False), 4: (0, True), 5: (0, False)}


def test_contamination_of_ids_that_repeat_and_no_benchmark(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(None, "x alpha beta gamma delta"), (None, "clean"), (4, "alpha beta gamma delta alpha beta gamma delta"), (4, "clean too"), (5, "a"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    found = sorted((r.doc_id or 0, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.find_contamination(docs, bench).collect())
    assert found == [(0, 1, 0, ""), (0, 5, 4, "1"), (4, 2, 0, ""), (4, 8, 8, "1"), (5, 1, 0, ""), (5, 1, 0, "")]
    assert all(r.n_hit == 0 and not r["items"] for r in decontaminate.find_contamination(docs, bench.limit(0)).collect())


@pytest.mark.parametrize(("order", "per_bucket"), [(3, 1_000_000), (3, 20), (2, 1_000_000), (2, 50)])  # with few in a bucket, inner words are split
def test_language_model(spark, monkeypatch, order, per_bucket):
    rows = ordinary(6) + [(100 + i, *r[1:]) for i, r in enumerate(whole_edges())]
    docs = spark.createDataFrame(rows, DOCS)
    buckets = ngram_lm.buckets_for(docs, "text", 1_000_000, 6.0)
    monkeypatch.setattr(ngram_lm, "buckets_for", lambda *_: buckets)
    monkeypatch.setattr(ngram_lm, "PER_BUCKET", per_bucket)
    found, want = got(ngram_lm.score_texts(docs, order=order).drop("perplexity"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), brute_lm.lm(pairs(rows), order)
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert found[k][:4] == v[:4]
        assert found[k][4:] == pytest.approx(v[4:], rel=1e-9)


def test_license_places_and_errors(spark):
    rows = [
        (1, "Released UNDER THE MIT LICENSE. Also under the mit license", "", "", 0),
        (2, "Licensed under the Apache Licence, Version 2.0", "", "", 0),
        (3, "code under teh mit license", "", "", 0),
        (4, "under the mit licenses", "", "", 0),
        (5, "This is licensed under the GNU General Public License, version 3", "", "", 0),
        (6, "the quick brown fox", "", "", 0),
    ]
    found = got(license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert found[1] == (10, 2, 1, 6, "mit", "mit", 1.0)
    assert found[2][1:6] == (0, None, None, "", "apache-2") and 0.9 < found[2][6] < 1
    assert found[3][1] == 0 and found[3][5] == "mit" and found[3][6] < 1
    assert found[4][1] == 0 and found[4][5] == "mit"
    assert found[5][5] == "gpl-3"
    assert found[6] == (4, 0, None, None, "", "", 0.0)


def test_fuzzy_search_misses_nothing():
    """Seeds find every place where the plain bounded search over the whole text does."""
    import random

    rng = random.Random(4)
    notices = [license_scan.Notice(p, label) for p, label in license_scan.NOTICES.items()]
    for _ in range(60):
        x = rng.choice(notices)
        words = list(x.phrase.decode())
        for _ in range(rng.randint(0, x.errors)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice(["", "q", words[at] + "q"])
        line = f" {sentence(rng, 8)} {''.join(words)} {sentence(rng, 8)} ".encode()
        assert bool(x.places(line)) == bool(x.pattern.search(line))


def test_license_scan_by_whole_search(spark):
    """Labels, places and scores as by the bounded search over whole texts, without seeds; of overlapping notices the better holds."""
    import random

    rng, notices = random.Random(17), list(license_scan.NOTICES.items())
    found = [license_scan.Notice(p, label) for p, label in notices]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            words = list(rng.choice(notices)[0].decode())
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["", "q", " "])
            parts += [sentence(rng, rng.randint(1, 6)), "".join(words).upper()]
        rows.append((i, ", ".join(parts), "", "", 0))
    got_rows = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, *_ in rows:
        words = brute.ALNUM.findall(text.encode().lower())
        line = b" " + b" ".join(words) + b" "
        base = {label for p, label in license_scan.PHRASES.items() if b" " + p + b" " in line}
        matches = sorted((sum(m.fuzzy_counts) / len(x.phrase), m.start(), m.end(), x.label) for x in found for m in x.pattern.finditer(line))
        taken = []
        for m in matches:
            if all(m[2] <= t[1] or t[2] <= m[1] for t in taken):
                taken.append(m)
        r = got_rows[i]
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | {m[3] for m in taken}))
        assert r.score == pytest.approx(max([float(bool(base)), *(1 - m[0] for m in matches)]))
        assert [(s.label, s.errors) for s in r.spans] == [(m[3], round(m[0] * 1000) and s.errors) for m, s in zip(taken, r.spans)]
