"""Every registered query against its SQL twin on the smallest driver tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_point

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry_point.oracle_sql()
QUERIES = {name: build for name, build in entry_point.queries().items() if name in entry_point.OPERATORS}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_only_models_lack_sql():
    assert set(QUERIES) - set(SQL) == {"forest_scores", "cluster_shortlist", "superpose"}
