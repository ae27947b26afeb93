"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest
from check_oracles import compare, oracle_connection

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        assert compare(df, con, entry.oracle_sql()[name]) is None
    else:
        assert df.limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
