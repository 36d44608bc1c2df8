"""From raw documents to a training mix: five stages, each written and read again.

Language identification, near-duplicate removal, repeated-span removal, benchmark
decontamination and source mixing, each over all that the stage before kept. A
stage decides by doc_id and text, so rows that share an id, or have none, are judged
each for itself; of rows that agree in both, the second stage keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import release, stage, staged, table
from tracemill.llm.decontaminate import find_contamination
from tracemill.llm.langid import identify_languages
from tracemill.llm.minhash import near_duplicates
from tracemill.llm.mixing import mix_sources
from tracemill.llm.suffix_dedup import remove_repeated_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle; an edit breaks more of the longer ones, so the test is stricter than op10's of four.
SHINGLE = 5
#: SQL cannot parse texts with automata nor follow links to components.
ORACLE_SQL = None


def own(docs: DataFrame) -> Column:
    """The hash of a row's text, by which operators name rows that share an id or have none."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def with_decision(docs: DataFrame, decision: DataFrame, how: str) -> DataFrame:
    """Join on doc_id, nulls alike, and text; ``decision`` calls them ``key`` and ``own``."""
    return docs.join(decision, docs["doc_id"].eqNullSafe(decision["key"]) & (own(docs) == decision["own"]), how)


def keep(docs: DataFrame, decision: DataFrame, test: Column) -> DataFrame:
    kept = decision.where(test).select(F.col("doc_id").alias("key"), "own")
    return with_decision(docs.select(*COLUMNS), kept, "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and those without letters go; a tie of languages, or a corpus to learn none from, rejects nothing."""
    return keep(docs, identify_languages(docs), F.col("lettered"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that agree in id and text, the one whose other columns sort first stays."""
    kept = keep(docs, near_duplicates(docs, shingle=SHINGLE), F.col("kept"))
    least = kept.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("least"))
    return least.select("doc_id", "text", "least.*").select(*COLUMNS)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = remove_repeated_spans(docs, carry=("lang", "source"))
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, find_contamination(docs, table(spark, sf_dir, "benchmark")), F.col("n_hit") == 0)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each; of rows that agree in id, text and source, as often as the one taken most."""
    counts = [F.max(c).alias(c) for c in ("size", "source_size", "target", "taken")]
    taken = mix_sources(docs).where("taken > 0").groupBy(F.col("doc_id").alias("key"), "own", "src").agg(*counts)
    joined = with_decision(docs.select(*COLUMNS), taken, "inner")
    return joined.where(F.col("source").eqNullSafe(F.col("src"))).drop("key", "own", "src")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", span_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has staged for itself is deleted when it ends."""
    before = staged()
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
            release(spark, before, but=1)  # the stage's own tables, and what it read
    return docs
