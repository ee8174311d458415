"""Every core query against DuckDB on the smallest data."""

import pytest

from tests.helpers import same_as_oracle
from tidemark.queries import problems, reference

QUERIES = problems.queries() | reference.queries()
ORACLE = problems.oracle_sql() | reference.oracle_sql()


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    same_as_oracle(QUERIES[name](spark, sf), duck, ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
