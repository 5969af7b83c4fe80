"""Queries over sources typed here, with typed answers."""

import pytest

from ashlar import catalog
from tests.oracle import DATA, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.FIXED))
def test_fixed(spark, con, name):
    query, sql = catalog.FIXED[name]
    same(query(spark, DATA), con, sql)
