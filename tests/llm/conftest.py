"""Small tables of the training-data tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import CLASHING, DOCS, at_the_edges, ordinary  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ordinary(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def edges(spark):
    """Rows at the edges, with extra columns whose names clash."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(at_the_edges(), DOCS).select("*", *[F.lit(7).alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
