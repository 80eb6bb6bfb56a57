"""Equal time intervals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsweave.constants import INTERVAL_FORMAT


def interval_seconds(start: Column, end: Column, pieces: int) -> Column:
    """Whole seconds in each of ``pieces`` equal intervals."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(pieces))


def interval_number(ts: Column, start: Column, end: Column, pieces: int) -> Column:
    """The interval an instant falls in, from 0; the last one takes the rest. In a
    range of fewer seconds than pieces all but the last have no length."""
    passed = F.unix_timestamp(ts) - F.unix_timestamp(start)
    length = interval_seconds(start, end, pieces)
    return F.when(length > 0, F.least(F.floor(passed / F.nullif(length, F.lit(0))), F.lit(pieces - 1))).otherwise(pieces - 1)


def intervals_of(bounds: DataFrame, pieces: int, start: str = "start", end: str = "end") -> DataFrame:
    """One row per interval for each row of ``bounds``, whose columns stay; an
    interval ends one second before the next begins, the last one ends with the
    range."""
    length = interval_seconds(F.col(start), F.col(end), pieces)
    begin = F.col(start) + F.make_dt_interval(secs=(F.col("number") * length))
    until = F.when(F.col("number") == pieces - 1, F.col(end)).otherwise(
        F.col(start) + F.make_dt_interval(secs=((F.col("number") + 1) * length - 1))
    )
    return bounds.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).select(
        *bounds.columns, F.col("number").cast("bigint").alias("interval"),
        F.date_format(begin, INTERVAL_FORMAT).alias("interval_start"),
        F.date_format(until, INTERVAL_FORMAT).alias("interval_end"),
    )


def time_intervals(spark: SparkSession, start: datetime, end: datetime, pieces: int) -> DataFrame:
    """Intervals between two given instants."""
    bounds = spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end"))
    return intervals_of(bounds, pieces).drop("start", "end")
