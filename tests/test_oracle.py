"""Every query that has SQL gives the rows DuckDB gives."""

from __future__ import annotations

import pytest

from newsweave.catalog import all_queries, all_sql
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, folder, connection, name):
    assert differences(all_queries()[name](spark, folder), connection, all_sql()[name]) == []


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["user_id", "news_id", "similarity_score", "rank"]
    assert not df.isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())
