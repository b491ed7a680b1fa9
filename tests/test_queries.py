"""Every catalogue query against its SQL, at the smallest scale, and those without SQL for a stable result."""

import pytest

from cadenza.plans import QUERIES, SQL
from tests.comparing import assert_same
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SMALL), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_are_stable(spark, name):
    first, again = (sorted(map(repr, QUERIES[name](spark, SMALL).collect())) for _ in range(2))
    assert first and first == again


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
