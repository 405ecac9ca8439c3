"""Every query of the library against its SQL; those without SQL run and give rows."""

import oracles
import pytest

from graphloom.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    return oracles.connection(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_like_sql(spark, data, con, name):
    assert not oracles.differences(catalog.QUERIES[name](spark, data), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES
