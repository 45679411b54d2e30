"""Every core data problem on empty tables, and on tables with extra columns of clashing names."""

import os

import pytest
from pyspark.sql import functions as F

from panelforge.plans import problems

TABLES = ("patent_records", "financial_observations", "financial_snapshots", "ma_events", "universe_registry", "universe_data_quality", "assignee_match_audit", "documents", "eval_items", "mix_targets", "provider_rank")
CLASH = ("grp", "field", "key", "at", "state", "node", "q", "v", "entity", "stage", "day", "tokens", "src", "rank", "company", "core", "n", "w", "pri", "h", "b")


def tables_in(spark, sf, to, make):
    for t in TABLES:
        at = os.path.join(to, f"{t}.parquet")
        if not os.path.exists(at):
            make(spark.read.parquet(f"{sf}/{t}.parquet")).write.parquet(at)
    return to


@pytest.fixture(scope="session")
def empty_dir(spark, sf, tmp_path_factory):
    return tables_in(spark, sf, str(tmp_path_factory.mktemp("empty")), lambda df: df.limit(0))


@pytest.fixture(scope="session")
def clash_dir(spark, sf, tmp_path_factory):
    """The tables twice over, with columns named like the operators' own."""
    extra = {c: F.lit("clash") for c in CLASH}
    return tables_in(spark, sf, str(tmp_path_factory.mktemp("clash")), lambda df: df.withColumns(extra))


FOUND = [n for n in problems.QUERIES if n.endswith("_found")]


@pytest.mark.parametrize("name", FOUND)
def test_empty(spark, empty_dir, name):
    assert problems.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", FOUND)
def test_clashing_columns(spark, sf, clash_dir, name):
    a, b = problems.QUERIES[name](spark, sf), problems.QUERIES[name](spark, clash_dir)
    assert a.schema == b.schema and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
