"""Every registered query against its SQL, on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from tradewake.plans.oracles import ORACLES
from tradewake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, SF)
    rows, difference = compare(result, duck, ORACLES[name])
    assert difference is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 30


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
