"""Queries of the subpackage against their SQL, on the small tables."""

import pytest

from tests.oracle import compare, connect
from tradewake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    rows, difference = compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
    assert difference is None
    assert rows > 0
