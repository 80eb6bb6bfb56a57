"""What several of the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsweave.session import cut_lineage

# Edges up to here are put together by one task, without rounds.
FEW_EDGES = 200_000


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
              column: str | None = None, most: int = 1 << 22) -> DataFrame:
    """``function`` over the Arrow batches of ``df``, one at a time, or over slices of
    them of about ``most`` bytes of ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from map(function, pieces(batch, column, most) if column else (batch,))

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the long pairs ``edges`` (a, b): root is the
    smallest node of its component.

    Large-star and small-star steps in turn. Every step is a partial minimum and
    an equality join, so a hub is neither gathered into one task nor expanded into
    pairs. Each round is cut from its lineage; the driver only sees a row count
    and a sum. Null ends and loops are left out. What is left when there are no more
    than FEW_EDGES is put together by one task.
    """
    current = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = cut_lineage(current)
    state = _state(current)
    while state[0] > FEW_EDGES:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Every larger neighbour goes to the smallest one.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # Every smaller neighbour goes to the smallest one, and the node itself too.
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(current)
        if before == state:
            break
    else:
        return current.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_together, "node long, root long")
    roots = current.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct())


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) for every node of the few edges (u, v)."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    nodes, at = np.unique(np.concatenate([u for u, _ in held] + [v for _, v in held]), return_inverse=True)
    left, right = np.split(at, 2)
    root = np.arange(len(nodes))
    while (root[left] != root[right]).any():
        # Every root that meets a smaller one goes to it, and all nodes follow.
        least = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], least)
        np.minimum.at(root, root[right], least)
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
