"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsweave.session import cut_lineage, stored

# Largest side that is sent whole to every executor, where its tasks share it.
BROADCAST_BYTES = 256 << 20
# A key with more rows than this on the large side is spread over several tasks,
# one for each so many rows.
HOT_ROWS = 1_000_000
# Rows whose key is null match nothing, and are spread over this many tasks.
NULL_SALTS = 64
# Hot keys that are sent whole to every executor.
HOT_KEYS = 100_000


def _field_bytes(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column) + 16
    elif isinstance(kind, T.ArrayType) and not isinstance(
        kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)
    ):
        size = F.size(column) * 8 + 32
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        size = F.octet_length(F.to_json(column)) + 32
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(8)).cast("bigint")


def row_bytes(df: DataFrame) -> Column:
    """Size of a row of ``df`` in memory."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        total = total + _field_bytes(F.col(field.name), field.dataType)
    return total


def table_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df`` in memory, measured in one aggregate."""
    return df.agg(F.sum(row_bytes(df)).alias("bytes")).first()["bytes"] or 0


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: str | list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    null_safe: bool = False,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which a hot key of ``big`` is split over one task for each
    ``hot_rows`` of its rows.

    ``small`` holds a key at most once. Its rows for hot keys are repeated once
    per salt, all others stay single. With ``null_safe`` a null key equals a null
    key; else its rows match nothing and are spread as well. The hot keys are
    counted once and broadcast if there are at most HOT_KEYS. The salt hashes the
    row, so a task that runs again sends it to the same place.

    The keys are counted before the join, so what stands behind ``big`` runs twice,
    reduced to its keys the first time. Where that is dear, cut ``big`` before, or give
    a stored table with the same keys in ``counted``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    hot = cut_lineage(
        (big if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
        .select(*[F.col(c).alias(f"_hot_{c}") for c in keys], F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_salts"))
    )
    hint = F.broadcast(hot) if hot.count() <= HOT_KEYS else hot
    row_hash = F.xxhash64(*[F.col(c) for c in big.columns])
    unmatched = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(row_hash, F.col("_salts")).cast("int"))
    if not null_safe:
        salt = F.when(unmatched, F.pmod(row_hash, F.lit(NULL_SALTS)).cast("int")).otherwise(salt)
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)

    def marked(side: DataFrame) -> DataFrame:
        return side.join(hint, [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in keys], "left").drop(*[f"_hot_{c}" for c in keys])

    left = marked(big).withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_salts")
    right = marked(small).withColumn("_salt", F.explode(copies)).drop("_salts")
    if not null_safe:
        return left.join(right, [*keys, "_salt"], how).drop("_salt")
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in [*keys, "_salt"] else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in [*keys, "_salt"]]
    return left.join(renamed, same, how).drop("_salt", *[f"_right_{c}" for c in [*keys, "_salt"]])


def bucketed(rows: DataFrame, group: str, item: str, table: DataFrame, most: int, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """``rows`` dealt by ``group`` into buckets (column _bucket) of about ``most`` rows, and
    for each bucket (column _of_bucket) the rows of ``table`` that its distinct ``item``
    values ask for. A row
    of the table so travels once for each bucket instead of once for each row that names
    it. A group of more than ``most`` rows is dealt by item over several buckets, unless
    groups are to stay ``whole``."""
    rows = stored(rows.where(F.col(item).isNotNull()).withColumn("_place", F.xxhash64(group)))
    buckets = max(-(-rows.count() // most), rows.sparkSession.sparkContext.defaultParallelism)
    if whole:
        dealt = rows.withColumn("_bucket", F.pmod(F.col("_place"), F.lit(buckets)).cast("int")).drop("_place")
        return dealt, dealt.select(F.col("_bucket").alias("_of_bucket"), item).distinct().join(table, item)
    large = cut_lineage(rows.groupBy("_place").count().where(F.col("count") > most).select(
        "_place", F.ceil(F.col("count") / most).cast("int").alias("_parts")))
    hint = F.broadcast(large) if large.count() <= HOT_KEYS else large
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(item), F.col("_parts"))).otherwise(F.lit(0))
    dealt = rows.join(hint, "_place", "left").withColumn("_bucket", F.pmod(F.xxhash64("_place", part), F.lit(buckets)).cast("int")).drop("_place", "_parts")
    return dealt, dealt.select(F.col("_bucket").alias("_of_bucket"), item).distinct().join(table, item)


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    keys: str | list[str],
    how: str = "inner",
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join to a table with unique keys: broadcast if its measured size is
    within ``budget``, else a salted shuffle join."""
    if table_bytes(table) <= budget:
        return big.join(F.broadcast(table), keys, how)
    return salted_join(big, table, keys, how)
