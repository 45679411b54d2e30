"""Every training-data problem on empty tables, and on tables with extra columns of clashing names."""

import pytest

from panelforge.llm import queries
from tests.test_empty import clash_dir, empty_dir  # noqa: F401

FOUND = [n for n in queries.QUERIES if n.endswith("_found")]


@pytest.mark.parametrize("name", FOUND)
def test_empty(spark, empty_dir, name):  # noqa: F811
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", FOUND)
def test_clashing_columns(spark, sf, clash_dir, name):  # noqa: F811
    a, b = queries.QUERIES[name](spark, sf), queries.QUERIES[name](spark, clash_dir)
    assert a.schema == b.schema and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
