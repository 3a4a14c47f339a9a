"""Every registered query of the catalog operators against its SQL."""

import pytest
from compare import connect, same

from skein.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same(spark, con, sf, name):
    same(spark, con, QUERIES[name], SQL[name], sf)


def test_flagship(spark, sf):
    assert QUERIES["flagship_hybrid_search"](spark, sf).count() > 0
