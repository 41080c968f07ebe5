import os

import duckdb
import pytest

import __spark_entry__ as entry
from sqlloom.catalogue import queries as catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    a = sorted(tuple(shown(r[c]) for c in sorted(columns)) for r in got.collect())
    place = [columns.index(c) for c in sorted(columns)]
    assert a == sorted(tuple(shown(r[i]) for i in place) for r in want.fetchall())


def test_entry(spark):
    assert os.path.isdir(SF) and entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
