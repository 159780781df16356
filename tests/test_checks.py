"""Every check query against its oracle, and the driver contract."""

import importlib

import pytest

from checks.compare import differences, duck
from checks.oracle import ORACLES
from checks.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    assert differences(spark, con, SMALL, name) == ""


def test_driver_contract(spark):
    driver = importlib.import_module("__spark_entry__")
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
