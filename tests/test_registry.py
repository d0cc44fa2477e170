"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from check import compare, duck
from workload import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(registry()) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and "relevance_score" in df.columns


@pytest.mark.parametrize("name", sorted(registry()))
def test_query(spark, con, name):
    outcome = compare(name, driver.queries()[name](spark, SF), con, driver.oracle_sql()[name])
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome
