"""Every core query with check SQL gives the same rows in both engines."""

import pytest
from tests.oracle import canon, connect

from panelforge.plans import catalog, problems

CASES = {**problems.ORACLE, **catalog.ORACLE}
QUERIES = {**problems.QUERIES, **catalog.QUERIES}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(CASES))
def test_same_rows(spark, con, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = con.sql(CASES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_every_query_is_listed():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
