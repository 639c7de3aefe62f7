"""Every query of the catalog against its DuckDB twin on the same files."""

import datetime
import glob
import os
from decimal import Decimal

import duckdb
import pytest

from lendscope.plans.catalog import CATALOG
from lendscope.plans.oracle import ORACLE
from lendscope.sources.loans import load_loans
from tests.conftest import ORACLE_DIR


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{ORACLE_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()[:10]
    assert not isinstance(value, Decimal), "money is to leave a query as a double"
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(CATALOG) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_matches_duckdb(spark, duck, name):
    ours = CATALOG[name](load_loans(spark, ORACLE_DIR))
    theirs = duck.execute(ORACLE[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    expected = _rows(names, theirs.fetchall())
    actual = _rows(ours.columns, [tuple(r) for r in ours.collect()])
    assert len(expected) > 0
    assert actual == expected
