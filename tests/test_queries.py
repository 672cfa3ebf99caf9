"""Every registered query of the engine gives the rows of its SQL."""

import pytest

from compare import connect, normal
from lectern.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_all_have_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) >= 45


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck):
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(duck.sql(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
