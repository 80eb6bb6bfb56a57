"""Counts and bounds of stored Parquet tables from the files' footers alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from newsweave.operators.corpus import union_all


def footer_table(spark: SparkSession, path: str) -> DataFrame:
    """The table in ``path``, read so that Spark answers counts, least and greatest
    values from the footers: no column chunk is read. Spark needs the settings for
    that when it plans, so the table belongs to a session of its own, which shares
    the context and leaves the caller's settings alone. Footers hold bounds of
    booleans, numbers and dates; bounds of other types, and anything filtered, are
    read from the rows as usual."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session.read.parquet(path)


def _count(column: Column | str = "*") -> Column:
    # A table without row groups gives null where Spark adds up the footers' counts,
    # which it takes for impossible, so coalesce would be dropped from the plan.
    return F.when(F.count(column) > 0, F.count(column)).otherwise(F.lit(0).cast("bigint"))


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row with the number of rows."""
    return footer_table(spark, path).agg(_count().alias("rows"))


def stored_bounds(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One row: rows, and for each column how many values it has (n_), the least (low_)
    and the greatest (high_).

    A file without a value in a column has no bounds for it, and one with NaN need not
    have them; Spark then fails. So the counts are taken first, from the footers: bounds
    of columns without nulls that hold integers, booleans or dates come from the footers
    too, all others from the column's rows.
    """
    table = footer_table(spark, path)
    counts = table.agg(_count().alias("rows"), *[_count(c).alias(f"n_{c}") for c in columns])
    held = counts.first()
    exact = {f.name for f in table.schema if isinstance(f.dataType, (T.IntegralType, T.BooleanType, T.DateType))}
    from_footers = [c for c in columns if c in exact and held["rows"] and held[f"n_{c}"] == held["rows"]]

    def bounds(source: DataFrame, names: Sequence[str]) -> DataFrame:
        return source.agg(*[f(c).alias(f"{word}_{c}") for c in names for word, f in (("low", F.min), ("high", F.max))])

    parts = [counts]
    if from_footers:
        parts.append(bounds(table, from_footers))
    if others := [c for c in columns if c not in from_footers]:
        parts.append(bounds(spark.read.parquet(path), others))
    # Tables of one row each.
    return reduce(DataFrame.crossJoin, parts).select("rows", *[f"{word}_{c}" for c in columns for word in ("n", "low", "high")])


def stored_readiness(spark: SparkSession, paths: dict[str, str], field: str) -> DataFrame:
    """Whether each table has a value in ``field``; a table without the field has none."""
    checks = []
    for name, path in paths.items():
        table = footer_table(spark, path)
        found = _count(field) > 0 if field in table.columns else _count() < 0
        checks.append(table.agg(found.alias("ready")).select(F.lit(name).alias("table_name"), "ready"))
    return union_all(*checks)


def stored_load_plan(spark: SparkSession, paths: dict[str, str], thresholds: dict[str, int]) -> DataFrame:
    """Rows, threshold and action per table: skip above the threshold, else load."""
    return union_all(*[
        stored_rows(spark, paths[name]).select(
            F.lit(name).alias("table_name"), "rows", F.lit(threshold).cast("bigint").alias("threshold"),
            F.when(F.col("rows") > threshold, "skip").otherwise("load").alias("action"))
        for name, threshold in thresholds.items()])
