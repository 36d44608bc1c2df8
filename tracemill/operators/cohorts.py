"""From animals' tables to one cohort: stacked, pruned, joined to their tuning and numbered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators import grids, recordings, relations
from tracemill.sources import tables

#: Parts of the names of columns that a cohort table leaves out.
DROPPED = ("Froi", "tif", "Pulse", "stimID", "rawPulse")


def compiled(animals: list[DataFrame], trace: str = "scaled") -> DataFrame:
    """Animals' tables of one family stacked by name: the trace under its canonical name, files and pulses left out.

    Animals are strings and regions numbers; a table without the trace is an error.
    """
    typed = [tables.without(recordings.canonical(x, trace), *DROPPED).withColumns({"animal": F.col("animal").cast("string"), "roi": F.col("roi").cast("double")}) for x in animals]
    return reduce(DataFrame.unionByName, typed)


def tuning(trials: DataFrame, cell: list[str], treatment: Column | None = None) -> DataFrame:
    """(cell, bf, dprime) of all animals at once, from the trials whose treatment passes."""
    rows = trials if treatment is None else trials.where(treatment)
    grid = grids.response_grid(rows, cell)
    return grids.best_frequency(grid, cell).join(grids.selectivity(grid, cell), cell)


def cohort(rows: DataFrame, tuned: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows of cells with a selectivity above ``least``, with their best frequency and dense numbers of animal and region."""
    kept = relations.with_dimension(rows, tuned, ["animal", "roi"], ["bf"], F.col("dprime") > least)
    return relations.dense_keys(kept, "animal", "roi")


def cells_by_animal(rows: DataFrame) -> DataFrame:
    """(animal, cells): how many different regions each animal has."""
    return rows.groupBy("animal").agg(F.count_distinct("roi").alias("cells"))
