"""Every registered query against its SQL on the smallest tables; rows-only queries must run and give rows."""
import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_oracles_belong_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        error, _ = compare(df, con, SQL[name])
        assert error is None, error
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
