"""Every registered query against its DuckDB oracle on the smallest tables,
and the driver's smoke entry."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracles import canon, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    sc, sr = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    dc, dr = canon([d[0] for d in cur.description], cur.fetchall())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(ORACLES)))
def test_query_without_oracle_returns_rows(spark, name):
    df = E.queries()[name](spark, SF)
    assert not df.isEmpty()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns
