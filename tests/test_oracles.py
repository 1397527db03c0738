"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import compare
import pytest

from migraspark.catalog import load

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def connection(tiny):
    return compare.connect(tiny)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, tiny, connection):
    df = QUERIES[name](spark, tiny)
    if name in ORACLES:
        assert compare.differences(df, ORACLES[name], connection) == []
    else:
        assert df.count() > 0


def test_every_query_has_its_sql():
    assert sorted(QUERIES) == sorted(ORACLES)
