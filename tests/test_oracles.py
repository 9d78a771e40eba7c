"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from dealscope.plans import load_all
from tools.compare import compare, connect

QUERIES = load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf, name):
    status, _, _, _, note = compare(spark, con, QUERIES[name], sf)
    assert status == "ok", (status, note)

