"""Every query with a SQL twin agrees with it on the smallest tables."""

import pytest

from roomfold.plans.catalog import ORACLES, QUERIES
from tests.compare import connection, difference, spark_rows, sql_rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert difference(spark_rows(QUERIES[name](spark, SMALL)), sql_rows(duck, ORACLES[name])) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
