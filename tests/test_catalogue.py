"""Every registered query of the library runs, and equals its SQL where it has one."""

import pytest

from tests.compare import spark_rows, sql_rows
from tessella.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    columns, rows = spark_rows(QUERIES[name](spark, data))
    if name in SQL:
        want_columns, want = sql_rows(SQL[name], data)
        assert columns == want_columns
        assert len(rows) == len(want)
        assert rows == want
    else:
        assert len(columns) == len(set(columns))
