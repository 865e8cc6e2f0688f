"""Results that SQL can state, against DuckDB on the same tables."""

import pytest
from quern.llm import queries

from tests.test_catalog import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):  # noqa: F811
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck.execute(queries.oracle_sql()[name]).df())
