"""Loading text files into tables, and the crawled-article corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsweave.constants import LOAD_THRESHOLDS
from newsweave.operators.corpus import crawled_fields, duplicate_titles, in_order, last_wins
from newsweave.sinks.versions import path_exists
from newsweave.sinks.writers import insert_past_errors, load_if_empty, load_plan
from newsweave.sources.tables import read_behaviors, read_news


def load_click_data(
    spark: SparkSession, files: dict[str, str], root: str, thresholds: dict[str, int] = LOAD_THRESHOLDS
) -> DataFrame:
    """Load the tab-separated ``files`` (by table name) that are below their
    threshold into tables below ``root``; a table with rows is left alone.
    Gives the plan that was followed."""
    readers = {name: read_news if name.startswith("news") else read_behaviors for name in files}
    current = {
        name: spark.read.parquet(f"{root}/{name}") if path_exists(spark, f"{root}/{name}")
        else readers[name](spark, path).limit(0)
        for name, path in files.items()
    }
    plan = load_plan(current, {name: thresholds[name] for name in files})
    # One row per table.
    for row in plan.collect():
        if row["action"] == "load":
            name = row["table_name"]
            load_if_empty(readers[name](spark, files[name]), f"{root}/{name}")
    return plan


def load_crawled(first: DataFrame, second: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Merge two crawls (the second wins), insert their articles into ``path``.
    Gives the report of duplicate titles and the rejected rows."""
    both = in_order(first, second)
    unique = last_wins(both, "_id", ["source_order"])
    rejected = insert_past_errors(crawled_fields(unique), path, "_id", ["_id"])
    return duplicate_titles(both), rejected
