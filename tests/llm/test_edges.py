"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import pytest
from cases import CLASHING, at_the_edges
from pyspark.sql import functions as F

from tracemill.llm import block_dedup, decontaminate, html_tree, langid, license_scan, minhash, mixing, ngram_lm, periodic, quality, sharding, spelling, suffix_dedup

BENCH = [(1, "a null id with some words"), (None, None), (2, "")]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


OPERATORS = {
    "lm": lambda spark, d: ngram_lm.score_texts(d),
    "mix": lambda spark, d: mixing.mix_sources(d),
    "quality": lambda spark, d: quality.quality_rules(d),
    "suffix": lambda spark, d: suffix_dedup.remove_repeated_spans(d),
    "langid": lambda spark, d: langid.identify_languages(d),
    "html": lambda spark, d: html_tree.extract_main_text(d, "doc_id", "source", "text"),
    "block": lambda spark, d: block_dedup.remove_repeats(d),
    "decontaminate": lambda spark, d: decontaminate.find_contamination(d, bench(spark)),
    "license": lambda spark, d: license_scan.scan_licenses(d),
    "minhash": lambda spark, d: minhash.near_duplicates(d),
    "periodic": lambda spark, d: periodic.find_runs(d, plant=True, keep_text=True),
    "shards": lambda spark, d: sharding.shard_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, edges, name):
    rows = OPERATORS[name](spark, edges).collect()
    ids = sorted((r[0] is not None, r[0] or 0) for r in rows)
    assert ids == sorted((r[0] is not None, r[0] or 0) for r in at_the_edges())
    twins = [r for r in rows if r[0] == 6]
    assert len(twins) == 2 and (name == "shards" or twins[0] == twins[1])  # rows of a shard have a slot each


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, nothing, name):
    assert OPERATORS[name](spark, nothing).collect() == []


def test_defined_results(spark, edges):
    quality_of = {r.doc_id: r for r in quality.quality_rules(edges).collect()}
    assert quality_of[1].n_words == 0 and quality_of[1].base_failed and not quality_of[1].kept
    assert quality_of[6].n_repeat_words == 8
    language = {r.doc_id: r for r in langid.identify_languages(edges).collect()}
    assert all((language[i].lang_pred, language[i].score) == ("und", 0.0) for i in (1, 2, 3, 7))
    near = {r.doc_id: r for r in minhash.near_duplicates(edges).collect()}
    assert [near[i].n_shingles for i in (1, 2, 3, 6)] == [0, 0, 0, 1] and near[1].kept and near[6].component_id == 6
    lm = {r.doc_id: r for r in ngram_lm.score_texts(edges).collect()}
    assert lm[1].n_tokens == lm[2].n_tokens == lm[3].n_tokens == 1


def test_spelling_edges(spark, edges, nothing):
    """Words are counted over all rows, those with null ids and repeated ones too."""
    assert spelling.group_variants(nothing, plant=True).collect() == []
    found = {r.word: r.n for r in spelling.group_variants(edges).collect()}
    words = [w for r in at_the_edges() for w in (r[1] or "").split()]
    assert found and all(n == words.count(w) for w, n in found.items())


def clashing(df):
    """The table with extra columns of the names that operators use inside."""
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING if c not in df.columns])


def test_pages_with_clashing_columns(spark):
    """No markup, no host, null url and html, rows that repeat, and an empty table."""
    page = "<html><body><article><p>One</p></article></body></html>"
    rows = [(1, "http://a.example/", page), (1, "http://a.example/", page), (None, None, None), (2, "not a url", "plain words"), (3, "http://a.example/x", ""), (4, None, "<p>a<p>b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_tree.extract_main_text(clashing(pages)).collect())
    assert found == [(0, "", 0), (1, "One", 3), (1, "One", 3), (2, "plain words", 11), (3, "", 0), (4, "a\nb", 3)]
    assert html_tree.extract_main_text(clashing(pages.limit(0))).collect() == []


def test_pipeline_stages(spark, edges, nothing, tmp_path):
    import corpus_pipeline

    clashing(bench(spark)).write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (edges, nothing):
        rows = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows if rows is start else clashing(rows), str(tmp_path)).cache()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert rows.columns == corpus_pipeline.COLUMNS
            rows.collect()
