import pytest

from quern import queries as q
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, name):
    assert assert_same(q.QUERIES[name](spark, SF), q.SQL[name], SF) > 0


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.SQL)
