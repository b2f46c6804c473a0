"""Every registered query runs and, where it has a counterpart, gives the counterpart's rows."""

from __future__ import annotations

import duckdb
import pytest

from aurigraph import catalog
from aurigraph.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def _plain(rows, places=6):
    from decimal import Decimal

    fix = lambda x: round(float(x), places) + 0.0 if isinstance(x, (float, Decimal)) else x
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = [tuple(r) for r in frame.select(*columns).collect()]
    if (sql := catalog.oracle_sql().get(name)) is None:
        assert columns
        return
    other = duck.sql(sql)
    assert sorted(other.columns) == columns
    assert _plain(rows) == _plain(other.project(", ".join(f'"{c}"' for c in columns)).fetchall())
