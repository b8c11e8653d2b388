"""Every registered query against its SQL twin."""

import oracle
import pytest

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    if name not in SQL:
        assert len(got)
        return
    assert oracle.difference(got, duck.execute(SQL[name]).fetchdf()) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
