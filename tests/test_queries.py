"""Every registered query against the SQL beside it, run by DuckDB over the same tables."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from quarryline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    found.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(SF).glob("*.parquet")):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return found


def plain(value):
    """Values as both engines give them; floats to six digits."""
    if isinstance(value, float | decimal.Decimal):
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    want_columns = [c[0] for c in want.description]
    have, expected = table(got.columns, got.collect()), table(want_columns, want.fetchall())
    spark.catalog.clearCache()
    assert have[0] == expected[0]
    assert len(have[1]) == len(expected[1])
    for a, b in zip(have[1], expected[1], strict=True):
        assert a == b or all(x == y or (isinstance(x, float) and isinstance(y, float | int) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert rows
    spark.catalog.clearCache()


def test_entry_has_all_queries():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
