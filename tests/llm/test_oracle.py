"""Queries with DuckDB SQL, over whole test tables."""

import glob
import os

import duckdb
import pytest

from lendscope.llm.catalog import ORACLE, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    ours = QUERIES[name](spark, SMALL)
    theirs = duck.execute(ORACLE[name])
    columns = sorted(d[0] for d in theirs.description)
    assert sorted(ours.columns) == columns
    names = [d[0] for d in theirs.description]
    expected = [tuple(row[names.index(c)] for c in columns) for row in theirs.fetchall()]
    actual = [tuple(row) for row in ours.select(*columns).collect()]
    assert expected
    assert sorted(actual, key=repr) == sorted(expected, key=repr)
