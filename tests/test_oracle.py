"""Every registered query at the smallest scale: DuckDB gives the same rows, or at least there are rows."""

import os

import pytest

import __spark_entry__ as contract
from oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"

if not os.path.isdir(SF_DIR):
    pytest.skip("driver tables are not here", allow_module_level=True)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    result = difference(spark, con, name, SF_DIR)
    assert result is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
