"""The queries whose contract SQL can state, against their SQL."""

import pytest
from compare import connect, same

from skein.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same(spark, con, sf, name):
    assert same(spark, con, QUERIES[name], SQL[name], sf) > 0
