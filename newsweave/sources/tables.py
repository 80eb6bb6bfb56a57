"""Scans of stored tables and of text files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsweave.constants import BEHAVIORS_SCHEMA, CRAWLED_SCHEMA, NEWS_SCHEMA
from newsweave.operators.corpus import in_order, last_wins, union_all


def read_table(spark: SparkSession, path: str | None = None, format: str = "parquet", **options: str) -> DataFrame:
    """A stored table. Any connector on the class path can be named."""
    return spark.read.format(format).options(**options).load(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, for work that is heavy per row, when the table has
    fewer files than there are cores. A large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_tsv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, null_tokens: Sequence[str] = ()
) -> DataFrame:
    """A tab-separated file without header. Quotes are ordinary characters.
    Fields equal to one of ``null_tokens`` read as null."""
    df = spark.read.csv(path, schema=schema, sep="\t", quote="", header=False)
    if not null_tokens:
        return df
    tokens = list(null_tokens)
    return df.select(*[
        F.when(~F.col(f.name).isin(tokens), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in schema.fields
    ])


def read_behaviors(spark: SparkSession, path: str | list[str], null_tokens: Sequence[str] = ()) -> DataFrame:
    return read_tsv(spark, path, BEHAVIORS_SCHEMA, null_tokens)


def read_news(spark: SparkSession, path: str | list[str], null_tokens: Sequence[str] = ()) -> DataFrame:
    return read_tsv(spark, path, NEWS_SCHEMA, null_tokens)


def read_articles(
    spark: SparkSession, path: str | list[str], schema: T.StructType = CRAWLED_SCHEMA, array: bool = True
) -> DataFrame:
    """Crawled articles from JSON: files that each hold one array, or, with
    ``array=False``, one object per line, which Spark can split."""
    return spark.read.json(path, schema=schema, multiLine=array)


@dataclass(frozen=True)
class ContentInput:
    """The tables of the content-based job."""

    embeddings: DataFrame
    train: DataFrame
    valid: DataFrame


def read_content_input(spark: SparkSession, embeddings: str, train: str, valid: str, **how: str) -> ContentInput:
    return ContentInput(*[read_table(spark, path, **how) for path in (embeddings, train, valid)])


@dataclass(frozen=True)
class ClusterInput:
    """The tables of the clustering job: vectors and unique articles."""

    embeddings: DataFrame
    news: DataFrame


def latest_news(*tables: DataFrame) -> DataFrame:
    """Unique articles of several tables; a later table wins, and within a table
    the rule of :func:`last_wins` for rows that tie."""
    columns = union_all(*tables).columns
    return last_wins(in_order(*tables), "news_id", ["source_order"]).select(*columns)


def read_cluster_input(spark: SparkSession, embeddings: str, news: Sequence[str], **how: str) -> ClusterInput:
    tables = [read_table(spark, path, **how) for path in news]
    return ClusterInput(read_table(spark, embeddings, **how), latest_news(*tables))


def readiness(tables: dict[str, DataFrame], field: str) -> DataFrame:
    """Whether each table has a row with a value in ``field``. Every scan ends
    at the first such row."""
    checks = []
    for name, table in tables.items():
        found = table.filter(F.col(field).isNotNull()) if field in table.columns else table.limit(0)
        checks.append(
            found.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("ready"))
            .select(F.lit(name).alias("table_name"), "ready")
        )
    return union_all(*checks)


def require_ready(tables: dict[str, DataFrame], field: str) -> None:
    """An error that names the tables without data."""
    missing = [row["table_name"] for row in readiness(tables, field).filter(~F.col("ready")).collect()]
    if missing:
        raise ValueError(f"no data yet in: {', '.join(missing)}")
