"""Every registered query against its SQL twin."""

import os

import pytest
from compare import difference, oracle

import __spark_entry__ as driver
from seqmodel.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(driver.queries()) and set(registry.ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    assert difference(driver.queries()[name](spark, SF_DIR), con, driver.oracle_sql()[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 1
