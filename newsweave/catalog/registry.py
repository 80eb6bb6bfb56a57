"""Where the queries register themselves."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
# Named parts that the SQL texts below may use, each built from earlier ones.
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None, like: str | None = None):
    """Register a function (spark, folder) -> DataFrame, and its SQL if any; ``like``
    names an earlier query with the same rows."""

    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = with_views(sql)
        if like:
            SQL[name] = SQL[like]
        return function

    return register


def with_views(body: str) -> str:
    """``body`` preceded by the views it uses, directly or through others."""
    needed: set[str] = set()
    texts = [body]
    while texts:
        text = texts.pop()
        for name, definition in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                texts.append(definition)
    if not needed:
        return body
    parts = ",\n".join(f"{name} as ({VIEWS[name]})" for name in VIEWS if name in needed)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {parts},\n{body[5:]}"
    return f"with {parts}\n{body}"
