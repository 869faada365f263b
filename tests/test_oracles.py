"""Every registered query against its DuckDB oracle on the smallest test data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracles import difference, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, con, name):
    assert difference(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(queries().keys() - oracle_sql().keys()))
def test_rows(spark, name):
    assert queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
