import pytest

from colex import more_queries  # noqa: F401
from colex import queries as Q

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert_same(Q.QUERIES[name](spark, sf_dir), Q.ORACLE_SQL[name], sf_dir)
