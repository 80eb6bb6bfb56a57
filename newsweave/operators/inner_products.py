"""The items with the greatest inner products, found in the order of their lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsweave.constants import TOP_K
from newsweave.operators.ranking import row_numbers
from newsweave.session import cut_lineage

# Items of a block, after each of which a user may stop, and bytes of items that are broadcast at once.
BLOCK_ITEMS = 512
PORTION_BYTES = 64 << 20
SLICE_USERS = 512
_STATE = "user_id int, features array<float>, items array<int>, scores array<double>, blocks long, open boolean"
_NAMES = [part.split()[0] for part in _STATE.split(", ")]


def _merged(items: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row, best first, ties to the lower item."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        rows, columns = np.nonzero(scores >= kth[:, None])
    else:
        rows, columns = np.indices(scores.shape).reshape(2, -1)
    order = np.lexsort((items[rows, columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    rows, columns = rows[keep], columns[keep]
    return items[rows, columns].reshape(len(scores), -1), scores[rows, columns].reshape(len(scores), -1)


def _walk(users: np.ndarray, items: np.ndarray, scores: np.ndarray, portion: tuple, k: int, block: int) -> tuple:
    """The users' best after the blocks of a portion, each as long as it can still matter."""
    ids, matrix, norms = portion
    length = np.linalg.norm(users, axis=1)
    visited, going = np.zeros(len(users), np.int64), np.ones(len(users), bool)
    for start in range(0, len(ids), block):
        if scores.shape[1] == k:
            # The slack is for rounding; an equal product may still win by its id.
            going &= length * norms[start] * (1 + 1e-9) + 1e-12 >= scores[:, -1]
        at = np.flatnonzero(going)
        if not len(at):
            break
        own = ids[start : start + block]
        product = users[at] @ matrix[start : start + block].T
        best, value = _merged(np.hstack([items[at], np.broadcast_to(own, (len(at), len(own)))]), np.hstack([scores[at], product]), k)
        if best.shape[1] > items.shape[1]:
            # Not yet k of them, so nobody has stopped.
            items, scores = best, value
        else:
            items[at], scores[at] = best, value
        visited[at] += 1
    if scores.shape[1] == k and len(ids):
        going &= length * norms[-1] * (1 + 1e-9) + 1e-12 >= scores[:, -1]
    return items, scores, visited, going


def best_items(
    users: DataFrame, items: DataFrame, k: int = TOP_K, block_items: int = BLOCK_ITEMS, portion_bytes: int = PORTION_BYTES
) -> DataFrame:
    """user_id, news_id, similarity_score, rank, blocks: the ``k`` items with the greatest
    inner product for every user, ties to the lower id, and how many blocks the user
    looked into. ``users`` and ``items``: id, features.

    Items go from the longest vector to the shortest, in blocks. As a product is at
    most the product of the lengths, a user stops at the first block whose longest
    item can't reach the k-th best so far. Blocks are broadcast in portions of at
    most ``portion_bytes``; after each, users that have stopped go out, and what the
    others have is written. Null features take no part.
    """
    users = users.where("features is not null").select(F.col("id").cast("int").alias("user_id"), F.col("features").cast("array<float>").alias("features"))
    squares = F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    items = items.where("features is not null").select(F.col("id").cast("int").alias("id"), "features", (-F.sqrt(squares)).alias("_short"))
    facts = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")).first()
    each = max(portion_bytes // (8 * (facts["width"] or 1) + 16), block_items) // block_items * block_items
    portions = -(-facts["n"] // each)
    if portions > 1:
        items = cut_lineage(row_numbers(items, ["_short", "id"], out="_place"))
    start = users.withColumn("items", F.array().cast("array<int>")).withColumn("scores", F.array().cast("array<double>")).withColumn(
        "blocks", F.lit(0).cast("long")).withColumn("open", F.lit(True)).select(*_NAMES)
    going, ended = start, []
    for number in range(portions):
        own = items if portions == 1 else items.where((F.col("_place") > number * each) & (F.col("_place") <= (number + 1) * each))
        table = own.orderBy("_short", "id").toArrow()
        ids = table.column("id").to_numpy().astype(np.int32)
        matrix = np.asarray(table.column("features").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        shared = users.sparkSession.sparkContext.broadcast((ids, matrix, -table.column("_short").to_numpy()))
        last = number == portions - 1

        def step(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, SLICE_USERS):
                    part = batch.slice(first, SLICE_USERS)
                    rows = part.num_rows

                    def matrix_of(column: int, kind: type) -> np.ndarray:
                        return np.array(part.column(column).flatten(), kind).reshape(rows, -1)

                    best, scores, visited, open_ = _walk(
                        matrix_of(1, np.float64), matrix_of(2, np.int32), matrix_of(3, np.float64), shared.value, k, block_items)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(list(best), pa.list_(pa.int32())), pa.array(list(scores), pa.list_(pa.float64())),
                         pa.array(part.column(4).to_numpy() + visited), pa.array(open_ & (not last))], _NAMES)

        state = going.mapInArrow(step, _STATE)
        if not last:
            state = cut_lineage(state)
            ended.append(state.where("not open"))
            going = state.where("open")
            shared.unpersist()
            if going.isEmpty():
                break
        else:
            ended.append(state)
    if not ended:
        ended = [start]
    whole = ended[0]
    for more in ended[1:]:
        whole = whole.unionByName(more)
    return whole.select("user_id", "blocks", F.posexplode(F.arrays_zip("items", "scores")).alias("_place", "_found")).select(
        "user_id", F.col("_found.items").alias("news_id"), F.col("_found.scores").alias("similarity_score"),
        (F.col("_place") + 1).cast("bigint").alias("rank"), "blocks")
