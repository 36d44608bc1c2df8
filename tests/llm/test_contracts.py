"""Contracts with SQL, held-out accuracy, and page extraction."""

from __future__ import annotations

import html
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tracemill.llm import html_tree, langid, mixing, quality, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    found = queries.queries()[name](spark, sf).toPandas()
    with duckdb.connect() as db:
        for name_of in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{sf}/{name_of}.parquet'")
        want = db.sql(queries.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    key = next(c for c in ("doc_id", "word") if c in columns)
    assert found[columns].sort_values(key).reset_index(drop=True).equals(want[columns].sort_values(key).reset_index(drop=True).astype(found[columns].dtypes.to_dict()))


def test_mix_meets_targets(spark, sf):
    rows = mixing.mix_sources(spark.read.parquet(f"{sf}/documents.parquet"))
    by = rows.groupBy("source_size", "target").agg({"taken": "sum", "size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= r["max(size)"] for r in by)
    assert rows.where("taken > 2 * size").count() == 0
    assert rows.exceptAll(mixing.mix_sources(spark.read.parquet(f"{sf}/documents.parquet"))).count() == 0


def test_sketch_bins(spark):
    values = spark.range(0, 5000).select(quality.sketch_bin(F.col("id")).alias("bin"), "id")
    for r in values.collect():
        assert r.bin <= r.id < r.bin + max(1, r.id / 32 + 1)


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'")
    right, total = found.where("lang = lang_pred").count(), found.count()
    assert total > 20 and right >= 0.95 * total


def test_suffix_automaton_knows_all_substrings():
    text = b"abcbcabba"
    step = langid.suffix_automaton(text)
    known = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def holds(x: bytes) -> bool:
        at = 0
        for c in x:
            if c not in step[at]:
                return False
            at = step[at][c]
        return True

    assert all(holds(x) for x in known) and not holds(b"abab") and not holds(b"cc")


def test_cross_parsing_counts_phrases():
    model = langid.Parser({"a": b"the cat sat", "b": b"xyz"})
    counts = model.phrases([b"the cat", b"the sat cat", b"", b"xyz"])
    assert counts[:, 0].tolist()[0] == 1 and counts[1, 0] == 3 and counts[2].tolist() == [0, 0] and counts[3].tolist() == [3, 1]
    assert counts[0, 0] < counts[0, 1] and counts[3, 1] < counts[3, 0]


def test_cross_parsing_of_long_texts_by_hand():
    """Greedy longest matches over whole texts, by search in the samples, whatever segments they are parsed in."""
    import random

    rng = random.Random(5)
    samples = {k: bytes(rng.choice(letters) for _ in range(n)) for k, letters, n in (("a", b"abc ", 300), ("b", b"abde ", 900), ("c", b"ab", 50))}
    samples["d"] = samples["a"] * 3
    found = [bytes(rng.choice(b"abcde ") for _ in range(n)) for n in (0, 1, 255, 256, 257, 700, 3000)] + [samples["a"] * 5, samples["b"][100:800], b"ab" * 700]

    def by_hand(text: bytes, sample: bytes) -> int:
        at = n = 0
        while at < len(text):
            k = 1
            while at + k < len(text) and text[at : at + k + 1] in sample:
                k += 1
            at, n = at + k, n + 1
        return n

    model = langid.Parser(samples)
    assert model.phrases(found).tolist() == [[by_hand(x, samples[k]) for k in model.languages] for x in found]


def test_sample_budget_is_spread():
    assert langid.level_of([1, 2, 300], 100) == 97 and langid.level_of([50, 50], 100) == 50 and langid.level_of([5, 5], 100) == 5 and langid.level_of([], 9) == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>News</ul></nav><div class="{ad}">Buy {n} now</div>
<div class="text"><h2>Title {n} &amp; more</h2><p>First   {n}<br>line<p>Second <em>{n}</em>&nbsp;&#8212; end<ul><li>one {n}<li>two {n}</ul></div>
<div class="box9"><p>Read our letter every week</p></div><section id="comments"><p>Great {n}!</p></section>
<aside>Other</aside><form><label>Mail</label><input name=x></form><div class="cookie-notice">We use cookies</div><footer>&copy; x</footer></body></html>"""


def test_style_tree_cuts_what_repeats(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=f"w{i}", ad="ads")) for i in range(12)] + [(99, "http://b.example/", PAGE.format(n="z", ad="ads"))]
    found = {r.page_id: r for r in html_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3].text == "Title w3 & more\nFirst w3\nline\nSecond w3 — end\none w3\ntwo w3"
    assert found[3].n_chars == len(found[3].text)
    assert found[99].text.endswith("Read our letter every week")  # a host of one page has no tree


def test_copies_of_one_article_stay(spark):
    page = "<html><body><div class='x'><p>Same text on all pages.</p></div></body></html>"
    rows = [(i, "http://a.example/", page) for i in range(10)]
    found = html_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in found.collect()} == {"Same text on all pages."}


def test_pages_of_the_tables(spark, sf):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.queries()["op6_main_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article))
        assert r.text == "\n".join(x for x in blocks if x)


def test_quality_keeps_good_and_drops_junk(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(docs.select("doc_id"), "doc_id")
    judged = quality.quality_rules(docs).join(labels, "doc_id")
    plain = judged.where("NOT base_failed")
    assert plain.where("quality = 1 AND NOT kept").count() <= 0.03 * plain.where("quality = 1").count()
    assert plain.where("quality = 0 AND NOT kept").count() >= 0.9 * plain.where("quality = 0").count()


