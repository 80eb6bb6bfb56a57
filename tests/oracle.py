"""Compare a query with its SQL in DuckDB: names, types, rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _kind(name: str) -> str:
    name = name.lower()
    for part, kind in (
        ("bigint", "bigint"), ("int64", "bigint"), ("hugeint", "hugeint"), ("int", "int"), ("double", "double"),
        ("float", "float"), ("string", "string"), ("varchar", "string"), ("bool", "boolean"),
    ):
        if part in name:
            return kind
    return name


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "" if value is None else f"{type(value).__name__}:{value}"


def differences(df, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, empty when nothing does."""
    relation = connection.sql(sql)
    ours = sorted((f.name, _kind(f.dataType.simpleString())) for f in df.schema.fields)
    theirs = sorted(zip(relation.columns, [_kind(str(t)) for t in relation.types]))
    found = [] if ours == theirs else [f"schema: {ours} and {theirs}"]
    names = [name for name, _ in ours]
    if names != [name for name, _ in theirs]:
        return found
    left = sorted(tuple(_cell(v) for v in row) for row in df.select(*names).collect())
    places = [relation.columns.index(name) for name in names]
    right = sorted(tuple(_cell(row[i]) for i in places) for row in relation.fetchall())
    if len(left) != len(right):
        found.append(f"rows: {len(left)} and {len(right)}")
    if left != right:
        gone, new = sorted(set(right) - set(left))[:2], sorted(set(left) - set(right))[:2]
        found.append(f"values: only here {new}, only there {gone}")
    if not left:
        found.append("no rows")
    return found
