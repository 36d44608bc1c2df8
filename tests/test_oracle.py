"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tracemill.jobs import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def normal(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else value


def rows_of(columns, rows):
    return sorted((tuple(normal(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    rows = [r.asDict() for r in found.collect()]
    assert rows
    if name in SQL:
        with duckdb.connect() as db:
            db.execute("SET TimeZone = 'UTC'")
            for f in Path(sf).glob("*.parquet"):
                db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
            want = db.execute(SQL[name])
            names = [c[0] for c in want.description]
            assert sorted(names) == columns
            assert rows_of(columns, rows) == rows_of(columns, [dict(zip(names, r, strict=True)) for r in want.fetchall()])


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["cell", "stim", "pk", "idx", "threshold", "sig"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
