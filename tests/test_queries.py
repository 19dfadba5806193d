"""Every query of the engine's own operators against its SQL, over the smallest tables."""

import pytest

import oracle
from quern.registry import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, oracle.SMALL)
    if name in SQL:
        assert not (found := oracle.difference(df, SQL[name], oracle.SMALL)), found
    else:
        assert df.columns and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
