"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle import connect, differences

from paceframe.registry import load_all

CATALOGUE = load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(CATALOGUE.queries))
def test_query_equals_sql(spark, sf, con, name):
    df = CATALOGUE.queries[name](spark, sf)
    if name in CATALOGUE.sql:
        assert differences(df, con, CATALOGUE.sql[name]) == []
    else:
        assert df.count() >= 0
