"""Every registered query with SQL gives the rows of DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from strandframe.plans import queries as q
from strandframe.plans import record_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr(tuple(r[n] for n in names)) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = q.QUERIES[name](spark, SF).toArrow(), duck.sql(q.ORACLES[name]).to_arrow_table()
    assert rows(got) == rows(want)
    assert sorted((f.name, str(f.type)) for f in got.schema) == sorted((f.name, str(f.type)) for f in want.schema)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0
