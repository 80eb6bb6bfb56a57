"""Row numbers, ranks and top-k selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave.functions.clicks import hash_fraction
from newsweave.session import cut_lineage

# Ranges whose bounds are written into the plan; more are cut by Spark itself.
MAX_CUT_POINTS = 256
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_k(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1.

    The comparison with ``k`` on ``row_number`` lets Spark cut every group to
    ``k`` rows before the shuffle, so a hot group never travels whole. Spark does
    so up to a threshold of the session; for a greater ``k`` each group is first
    dealt over several tasks, and the ``k`` first of each meet again.
    """
    group = [group] if isinstance(group, str) else list(group)

    def first(rows: DataFrame, keys: list[str]) -> DataFrame:
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("_position", position).filter(F.col("_position") <= k)

    if k > int(df.sparkSession.conf.get(_GROUP_LIMIT, "1000")):
        shares = default_pieces(df)
        dealt = df.withColumn("_share", F.pmod(F.xxhash64(*df.columns), F.lit(shares)))
        df = first(dealt, [*group, "_share"]).drop("_share", "_position")
    return first(df, group).withColumn(rank, F.col("_position").cast("bigint")).drop("_position")


def _cut_points(df: DataFrame, order: list[str], pieces: int) -> list[tuple]:
    """``pieces - 1`` key values that split the rows evenly. They come from the
    keys with the lowest hashes: a fair sample that is the same in every run."""
    sample = (
        df.select(*order).na.drop().orderBy(F.xxhash64(*order), *order).limit(pieces * 32).collect()
    )
    values = sorted(tuple(row) for row in sample)
    picks = [values[i * len(values) // pieces] for i in range(1, pieces)] if values else []
    return sorted(set(picks))


def _at_or_after(order: list[str], cut: tuple) -> Column:
    """Whether the row's key is at or after ``cut``, column by column. A null
    column makes this null, which counts as before."""
    result = F.col(order[-1]) >= F.lit(cut[-1])
    for name, value in zip(order[-2::-1], cut[-2::-1]):
        result = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & result)
    return result


def _piece(order: list[str], cuts: list[tuple]) -> Column:
    """How many cut points are at or before the row's key, by bisection."""

    def bisect(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(_at_or_after(order, cuts[middle]), bisect(middle + 1, high)).otherwise(bisect(low, middle))

    return bisect(0, len(cuts))


def row_numbers(
    df: DataFrame,
    order: str | Sequence[str],
    group: Sequence[str] = (),
    out: str = "row_num",
    pieces: int | None = None,
    piece: Column | None = None,
) -> DataFrame:
    """Row number from 1 in ascending ``order`` within ``group`` (or overall),
    without ever sorting a whole group in one task.

    The order columns are cut into ranges. A row's number is the count of rows
    in earlier ranges of its group plus its place in its own range. ``order``
    should identify a row, as ties are the only thing that cannot be split.
    Cut points are sampled unless ``piece``, an int that never falls along the
    order, says which of the ``pieces`` ranges a row is in. Up to MAX_CUT_POINTS
    ranges are an expression; more are a range shuffle, written out so that the
    sizes and the numbers see the same ranges.
    """
    order = [order] if isinstance(order, str) else list(order)
    group = list(group)
    if pieces is None:
        pieces = default_pieces(df)
    if piece is None and pieces > MAX_CUT_POINTS:
        ranged = df.repartitionByRange(pieces, *[F.asc_nulls_first(c) for c in order])
        placed = cut_lineage(ranged.withColumn("_piece", F.spark_partition_id()))
    else:
        placed = df.withColumn("_piece", _piece(order, _cut_points(df, order, pieces)) if piece is None else piece)
    keys = [*group, "_piece"]
    # At most ``pieces`` rows per group reach the window over the sizes.
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy(*(group or [F.lit(0)])).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *[F.col(c).alias(f"_of_{c}") for c in keys],
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
    )
    if not group:
        # One row per range.
        offsets = F.broadcast(offsets)
    within = F.row_number().over(
        Window.partitionBy(*keys).orderBy(*[F.asc_nulls_first(c) for c in order])
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    numbered = placed.join(offsets, same).withColumn(out, (F.col("_before") + within).cast("bigint"))
    return numbered.select(*df.columns, out)


def default_pieces(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hash_piece(key: Column, pieces: int) -> Column:
    """The range of an md5 text among ``pieces`` equal ones."""
    return F.floor(hash_fraction(key) * pieces).cast("int")


def batch_numbers(df: DataFrame, order: str | Sequence[str], size: int, out: str = "batch") -> DataFrame:
    """Overall row number by ``order`` and the batch of ``size`` rows it is in."""
    return row_numbers(df, order).withColumn(out, F.floor((F.col("row_num") - 1) / size).cast("bigint"))


def distributed_index(df: DataFrame, key: str, batch_size: int) -> DataFrame:
    """A gapless index from 0 in the order of the key's hash, and its batch."""
    hashed = df.withColumn("_hash", F.md5(F.col(key).cast("string")))
    pieces = default_pieces(df)
    index = row_numbers(hashed, ["_hash", key], pieces=pieces, piece=hash_piece(F.col("_hash"), pieces))
    return (
        index.withColumn("unique_id", F.col("row_num") - 1).drop("row_num", "_hash")
        .withColumn("batch_num", F.floor(F.col("unique_id") / batch_size).cast("bigint"))
    )
