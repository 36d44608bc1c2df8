"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import block_dedup, decontaminate, html_tree, langid, license_scan, minhash, mixing, ngram_lm, periodic, quality, sharding, spelling, suffix_dedup
from tracemill.llm.common import table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_lm.score_texts(table(spark, sf_dir, "documents")).drop("perplexity")
    return found.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("base_score", "score")})


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("src", "own")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_spans(table(spark, sf_dir, "documents")).drop("kept_text", "own")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents")).drop("own", "lettered")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract_main_text(table(spark, sf_dir, "pages"))


def op7_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=2)
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("own")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(table(spark, sf_dir, "documents"), plant=True).drop("own")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), plant=True)


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).drop("own")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_mix_sources, op3_quality_rules, op4_suffix_dedup, op5_language_id, op6_main_text, op7_block_dedup, op8_decontaminate, op9_license_scan, op10_minhash, op11_periodic_runs, op12_spelling_variants, op13_shards)}


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_score": ngram_lm.ORACLE, "op2_mix_sources": mixing.ORACLE, "op3_quality_rules": quality.ORACLE, "op7_block_dedup": block_dedup.ORACLE, "op8_decontaminate": decontaminate.ORACLE, "op11_periodic_runs": periodic.ORACLE, "op12_spelling_variants": spelling.ORACLE, "op13_shards": sharding.ORACLE}
