"""Every query of the catalogue against its SQL."""

import pytest

from ashlar import catalog
from tests.oracle import DATA, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    same(catalog.QUERIES[name](spark, DATA), con, catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
