"""Each query of the library against its SQL in DuckDB."""

import __spark_entry__ as entry
import pytest
from tidemill.registry import QUERIES, SQL

from oracle import SF, duck_rows, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    found = rows(QUERIES[name](spark, SF).toPandas())
    if name in SQL:
        assert found == duck_rows(SQL[name])
    else:
        assert found[0]


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
