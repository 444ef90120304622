import pytest

import solframe.queries_data  # noqa: F401  adds its queries
from solframe.queries import QUERIES, SQL

from .helpers import compare


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
