"""Every catalogue query at the smallest scale, next to its SQL twin."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 2


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toArrow()
    if name in SQL:
        assert compare(got, con.execute(SQL[name]).to_arrow_table()) is None
    else:
        assert got.num_rows and len(set(got.column_names)) == len(got.column_names)
