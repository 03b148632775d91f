"""Every registered query against its SQL over the smallest driver tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry_point(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_a_query_each():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) == []


@pytest.mark.parametrize("name", ["iso_forest_fit", "gbt_predict", "feature_importance", "model_roundtrip"])
def test_model_queries_give_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0
