"""Quality rules with thresholds learned per language and source.

Each measure of a document is an integer. A group's distribution is kept as a
log-linear histogram (exact below 64, then 32 bins for each power of two, so a
quantile is off by at most a 32nd). Such sketches are sums of counts: they merge
by addition, from (language, source) to language to everything, and have at most
a few hundred bins. A document fails where a measure lies beyond its group's
fence, quartile plus three times the quartile distance plus a fixed slack.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import settled, stage, staged
from tracemill.shipping import ship

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Slack of each measure's fence: hundredths of a character, else thousandths.
SLACK = {"word_length": 100, "symbols": 150, "dup_lines": 400, "repeats": 250}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def count_text(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts, covered = Counter(windows), 0
    if len(counts) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), covered


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [count_text(x.as_py() or "") for x in batch.column("text")]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "lang", "source")] + columns, ["doc_id", "lang", "source", *COUNTS])


def sketch_bin(x: Column) -> Column:
    """The lower end of x's bin."""
    drop = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def measures() -> dict[str, Column]:
    per_word = lambda n, k: F.expr(f"{k} * {n} div greatest(n_words, 1)")
    return {"word_length": per_word("word_chars", 100), "symbols": per_word("n_symbols", 1000), "dup_lines": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"), "repeats": per_word("n_repeat_words", 1000)}


def fences(counted: DataFrame, weight: int) -> DataFrame:
    """(lang, source, measure -> low, high): each sketch's fences drawn towards the next wider sketch's, which count as ``weight`` documents."""
    names = list(SLACK)
    long = counted.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), sketch_bin(v).alias("bin")) for k, v in measures().items()])).alias("x"))
    fine = long.groupBy("lang", "source", "x.measure", "x.bin").count()
    merged = {"fine": ["lang", "source"], "lang": ["lang"], "all": []}
    quartiles = {}
    for level, keys in merged.items():
        sketch = fine.groupBy(*keys, "measure", "bin").agg(F.sum("count").alias("count"))
        group = Window.partitionBy(*keys, "measure")
        ranked = sketch.withColumn("n", F.sum("count").over(group)).withColumn("upto", F.sum("count").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("n") * q, F.col("bin")))
        q = ranked.groupBy(*keys, "measure").agg(F.max("n").alias("n"), at(1).alias("q1"), at(3).alias("q3"))
        slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("measure"))
        wide = F.col("q3") - F.col("q1")
        q = q.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("measure") == m, x)).alias(f"{m}_{side}") for m in names for side, x in (("low", F.col("q1") - 3 * wide - slack), ("high", F.col("q3") + 3 * wide + slack))])
        quartiles[level] = q.select(*[F.col(k).alias(f"{level}_{k}") for k in keys], *[F.col(c).alias(f"{level}_{c}") for c in q.columns if c not in keys])
    overall = quartiles["all"].first().asDict()  # one row of nine numbers
    groups = counted.select("lang", "source").distinct()
    groups = groups.join(quartiles["fine"], F.col("lang").eqNullSafe(F.col("fine_lang")) & F.col("source").eqNullSafe(F.col("fine_source")), "left")
    groups = groups.join(quartiles["lang"], F.col("lang").eqNullSafe(F.col("lang_lang")), "left")
    none, w = F.lit(0.0), F.lit(float(weight))
    of = lambda level, c: F.coalesce(F.col(f"{level}_{c}").cast("double"), none)
    drawn = lambda level, c, wider: (of(level, "n") * of(level, c) + w * wider) / (of(level, "n") + w)
    pick = lambda c: drawn("fine", c, drawn("lang", c, F.lit(overall[f"all_{c}"]).cast("double")))
    return groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[pick(f"{m}_{s}").alias(f"{m}_{s}") for m in names for s in ("low", "high")])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", weight: int = 100) -> DataFrame:
    """Counts of each document, whether the fixed rule fails it, and whether it is kept.

    A null text counts as empty: no words, so it fails. A null language or source
    is a group of its own. A group's fences are its own and its language's, weighted
    by its plausible documents and by ``weight``, and a language's likewise with those
    of all documents, so that the fewer there are the more the wider sketch tells.
    Without plausible documents nothing passes the fixed rule anyway. Repeated rows count each time.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "lang", "source")) + "".join(f", {c} long" for c in COUNTS)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    begun = staged()
    counted = stage(rows.mapInArrow(measured, schema).withColumn("base_failed", failed), "quality-counts")
    limits = stage(fences(counted, weight), "quality-fences")
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    inside = [(v <= F.col(f"{m}_high")) for m, v in measures().items()] + [measures()["word_length"] >= F.col("word_length_low")]
    kept = ~F.col("base_failed")
    for test in inside:
        kept = kept & F.coalesce(test, F.lit(True))
    return settled(joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")), "quality", begun)


ORACLE = r"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM base),
windows AS (
  SELECT doc_id, i, w || chr(0) || lead(w, 1) OVER d || chr(0) || lead(w, 2) OVER d AS tri FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) > 1 AS again FROM windows WHERE tri IS NOT NULL),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM found WHERE again) GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, b.lang, b.source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * word_chars // greatest(n_words, 1) AS word_length,
         1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM counted),
lengthy AS (UNPIVOT (SELECT lang, source, word_length, symbols, dup_lines, repeats FROM judged WHERE NOT base_failed) ON word_length, symbols, dup_lines, repeats INTO NAME measure VALUE x),
binned AS (SELECT *, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS b FROM lengthy),
ranked AS (
  SELECT measure, b, 'fine' AS level, lang, source, count(*) OVER (PARTITION BY lang, source, measure) AS n, count(*) OVER (PARTITION BY lang, source, measure ORDER BY b) AS upto FROM binned
  UNION ALL SELECT measure, b, 'lang', lang, NULL, count(*) OVER (PARTITION BY lang, measure), count(*) OVER (PARTITION BY lang, measure ORDER BY b) FROM binned
  UNION ALL SELECT measure, b, 'all', NULL, NULL, count(*) OVER (PARTITION BY measure), count(*) OVER (PARTITION BY measure ORDER BY b) FROM binned),
quartiles AS (SELECT level, lang, source, measure, max(n) AS n, min(b) FILTER (upto * 4 >= n) AS q1, min(b) FILTER (upto * 4 >= n * 3) AS q3 FROM ranked GROUP BY ALL),
fence AS (
  SELECT level, lang, source, max(n) AS n, max(q1 - 3 * (q3 - q1) - 100) FILTER (measure = 'word_length') AS lo, max(q3 + 3 * (q3 - q1) + 100) FILTER (measure = 'word_length') AS hi,
         max(q3 + 3 * (q3 - q1) + 150) FILTER (measure = 'symbols') AS sy, max(q3 + 3 * (q3 - q1) + 400) FILTER (measure = 'dup_lines') AS du, max(q3 + 3 * (q3 - q1) + 250) FILTER (measure = 'repeats') AS re
  FROM quartiles GROUP BY ALL),
picked AS (
  SELECT j.*, BLEND(lo) AS lo,
         BLEND(hi) AS hi, BLEND(sy) AS sy, BLEND(du) AS du, BLEND(re) AS re
  FROM judged j LEFT JOIN fence f ON f.level = 'fine' AND f.lang IS NOT DISTINCT FROM j.lang AND f.source IS NOT DISTINCT FROM j.source
  LEFT JOIN fence l ON l.level = 'lang' AND l.lang IS NOT DISTINCT FROM j.lang LEFT JOIN fence a ON a.level = 'all')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_length BETWEEN lo AND hi, true) AND coalesce(symbols <= sy, true) AND coalesce(dup_lines <= du, true) AND coalesce(repeats <= re, true) AS kept
FROM picked
"""
ORACLE = re.sub(r"BLEND\((\w+)\)", r"((coalesce(f.n, 0)::DOUBLE * coalesce(f.\1, 0)::DOUBLE + 100::DOUBLE * ((coalesce(l.n, 0)::DOUBLE * coalesce(l.\1, 0)::DOUBLE + 100::DOUBLE * a.\1::DOUBLE) / (coalesce(l.n, 0)::DOUBLE + 100::DOUBLE))) / (coalesce(f.n, 0)::DOUBLE + 100::DOUBLE))", ORACLE)
