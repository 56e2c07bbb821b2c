"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from compare import connect, data_dir, difference

FOLDER = data_dir("0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    sql = contract.oracle_sql().get(name)
    frame = contract.queries()[name](spark, FOLDER)
    if sql is None:
        assert frame.count() >= 0
    else:
        assert difference(frame, con, sql) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 1511
