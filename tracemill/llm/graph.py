"""Connected components by alternating stars, for links of any number and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import stage

#: A key with more than this share of all rows is hot; at most as many keys as its inverse can be, so hot ones are broadcast.
HOT = 1 / 512
#: Rows of one key that a task takes in any case.
LEAST = 1000


def beside(rows: DataFrame, summary: DataFrame, key: str, total: int) -> DataFrame:
    """Rows with their key's line of ``summary``, which says with column n how many of ``total`` rows have it.

    Hot keys, fewer than 1 / HOT by their definition, come by broadcast, so that
    their rows stay where they are; the others meet their line by a shuffled join.
    """
    bound = max(LEAST, total * HOT)
    hot = summary.where(F.col("n") > bound)
    names = [c for c in summary.columns if c != key]
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*names).alias("_hot"))), key, "left")
    cold = marked.where("_hot IS NULL").drop("_hot").join(summary.where(F.col("n") <= bound), key)
    return cold.unionByName(marked.where("_hot IS NOT NULL").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in names]))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, for every node but those smallest.

    Each round hangs the larger neighbours of every node on its smallest one, then
    the smaller ones likewise. Links only ever become stars, so their number never
    exceeds the number given, and rounds grow with the logarithm of a path's length.
    They end when no node with a smaller neighbour has another one: then every
    component is a star around its smallest node.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a"))
        low = both.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        total, most, unsettled = low.agg(F.sum("n"), F.max("n"), F.count_if((F.col("m") < F.col("v")) & (F.col("n") > 1))).first()
        if not unsettled:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        low = low.select("v", F.least("v", "m").alias("m"), "n")
        hot = most > max(LEAST, total * HOT)
        met = (lambda rows, summary, key: beside(rows, summary, key, total)) if hot else (lambda rows, summary, key: rows.join(summary.drop("n"), key))
        large = met(both, low, "v").where("u > v").select("m", "u")
        if hot:  # read four times below
            large = stage(large, "links-large")
        least = large.groupBy("u").agg(F.min("m").alias("root"), F.count("*").alias("n"))
        hung = met(large, least, "u").where("m <> root").select(F.col("root").alias("a"), F.col("m").alias("b"))
        edges = stage(hung.union(least.select("root", "u")).distinct(), "links")
