import pytest

from foliant import office_queries, output_queries, place_queries, queries, session_queries, stream_queries  # noqa: F401
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    check(spark, SF, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
