"""Every operator as a query over the test tables, with the same query in SQL."""

from newsweave.catalog import registry
from newsweave.catalog import (  # noqa: F401
    article_queries, click_queries, evaluation_queries, flagship, model_queries, table_queries, vector_queries,
)
# Takes SQL texts of the queries above.
from newsweave.catalog import set_queries  # noqa: E402,F401


def all_queries():
    return dict(registry.QUERIES)


def all_sql():
    return dict(registry.SQL)
