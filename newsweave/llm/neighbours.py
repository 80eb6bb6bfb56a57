"""Approximate nearest neighbours through learned partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsweave.operators.ranking import top_k
from newsweave.session import cut_lineage

# Rows the partition is learned from, rows a part is meant to hold, and the least
# number of sampled rows that make a part.
SAMPLE_ROWS = 8_192
PART_ROWS = 2_048
PART_SAMPLE = 64
# Share of true neighbours, among the sample, that the probed parts must hold.
RECALL = 0.95
GRAPH_NEIGHBOURS = 16
IMBALANCE = 1.1
HIDDEN = 128
EPOCHS = 20
# Rows and queries that meet in one task at once. Parts share a block up to this
# size, so that a query brings its best from all of them together.
BLOCK_ROWS = 16_384
_SLICE = 256


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles): rows with a vec_id whose vector is not null,
    not zero and has finite components only, as many as most vectors have (the
    more, on a tie)."""
    e = F.col("embedding").cast("array<double>")
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0))
    sizes = sound.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sound.where(F.size("embedding") == (sizes["d"] if sizes else 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def neighbour_graph(rows: np.ndarray, k: int) -> np.ndarray:
    """For each row, the k others with the largest inner product."""
    found = np.empty((len(rows), k), np.int64)
    for at in range(0, len(rows), 1024):
        scores = rows[at : at + 1024] @ rows.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        found[at : at + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return found


def balanced_parts(rows: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row: halved along the direction of most spread again and
    again, then moved to where most neighbours are while there is room."""
    label = np.zeros(len(rows), np.int64)
    todo, next_label = [(np.arange(len(rows)), parts, 0)], 1
    while todo:
        members, count, own = todo.pop()
        if count < 2 or len(members) < 2:
            continue
        centred = rows[members] - rows[members].mean(axis=0)
        direction = np.linalg.svd(centred[:: max(1, len(centred) // 1024)], full_matrices=False)[2][0]
        order = members[np.argsort(centred @ direction, kind="stable")]
        cut = len(order) * (count // 2) // count
        label[order[cut:]] = next_label
        todo += [(order[:cut], count // 2, own), (order[cut:], count - count // 2, next_label)]
        next_label += 1
    room = int(np.ceil(len(rows) / parts * IMBALANCE))
    sizes = np.bincount(label, minlength=parts)
    reverse = [[] for _ in range(len(rows))]
    for i, others in enumerate(graph.tolist()):
        for j in others:
            reverse[j].append(i)
    for _ in range(6):
        moved = 0
        for i in range(len(rows)):
            votes = np.bincount(label[np.concatenate((graph[i], np.array(reverse[i], np.int64)))], minlength=parts)
            best = int(np.argmax(np.where((sizes < room) | (np.arange(parts) == label[i]), votes, -1)))
            if votes[best] > votes[label[i]]:
                sizes[label[i]] -= 1
                sizes[best] += 1
                label[i] = best
                moved += 1
        if moved < len(rows) // 200:
            break
    return label


@dataclass
class Router:
    """A classifier with one hidden layer, from a vector to its part."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(rows * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def trained(cls, rows: np.ndarray, targets: np.ndarray) -> Router:
        """Fit to ``targets`` (a distribution over parts per row) by Adam."""
        generator = np.random.default_rng(7)
        d, parts = rows.shape[1], targets.shape[1]
        scale = 1 / (np.abs(rows).mean() + 1e-12)
        values = [generator.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN),
                  generator.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(EPOCHS):
            order = generator.permutation(len(rows))
            for at in range(0, len(order), 256):
                pick = order[at : at + 256]
                x = rows[pick] * scale
                hidden = np.maximum(x @ values[0] + values[1], 0)
                out = hidden @ values[2] + values[3]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                slope = (out / out.sum(axis=1, keepdims=True) - targets[pick]) / len(pick)
                back = (slope @ values[2].T) * (hidden > 0)
                slopes = [x.T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
                step += 1
                for v, s, m, q in zip(values, slopes, first, second):
                    m += 0.1 * (s - m)
                    q += 0.001 * (s * s - q)
                    v -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
        return cls(*values, scale)


@dataclass
class Partition:
    router: Router
    parts: int
    probes: int


def learn(rows: np.ndarray, total: int, k: int, recall: float = RECALL) -> Partition:
    """Parts, their classifier, and how many parts a query must visit so that, of
    the sampled rows, ``recall`` of each one's nearest lie in those parts."""
    parts = max(1, min(-(-total // PART_ROWS), len(rows) // PART_SAMPLE))
    if parts == 1:
        return Partition(Router(np.zeros((rows.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0), 1, 1)
    near = neighbour_graph(rows, min(k, len(rows) - 1))
    graph = near[:, :GRAPH_NEIGHBOURS]
    label = balanced_parts(_unit(rows), graph, parts)
    # A row is sent where it is itself, and where its neighbours are.
    targets = np.zeros((len(rows), parts))
    np.add.at(targets, (np.repeat(np.arange(len(rows)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    targets[np.arange(len(rows)), label] += 0.5
    teach = np.arange(len(rows)) % 5 > 0
    router = Router.trained(rows[teach], targets[teach])
    ask = np.flatnonzero(~teach)
    score = router.scores(rows)
    home = score.argmax(axis=1)
    order = np.argsort(-score[ask], axis=1)
    rank = np.argsort(order, axis=1)
    places = np.take_along_axis(rank, home[near[ask]], axis=1)
    held = [(places < m).mean() for m in range(1, parts + 1)]
    probes = next((m for m, h in enumerate(held, 1) if h >= recall), parts)
    return Partition(router, parts, probes)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _routed(vectors: DataFrame, partition: Partition, probes: int) -> DataFrame:
    """``vectors`` (vec_id, embedding) with ``parts``, the most probable ones first."""
    shared = vectors.sparkSession.sparkContext.broadcast(partition)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = shared.value.router.scores(_matrix(batch.column(1)))
                best = np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1) * best.shape[1], pa.int32()), pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "embedding", "parts"])

    return vectors.mapInArrow(run, "vec_id long, embedding array<double>, parts array<int>")


def best_in_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, open_=None
) -> pd.DataFrame:
    """Each query's k best rows of a block, among those that it visits: ``open_`` of
    two places gives the mask of the queries between them. A matrix product picks those within
    rounding of the k-th best, then each is summed alone, so that equal vectors get
    equal scores and ties go to the smaller id."""
    found = []
    reach = np.abs(rows).max() * rows.shape[1] * 1e-12 if len(rows) else 0.0
    for at in range(0, len(queries), _SLICE):
        part = queries[at : at + _SLICE]
        scores = part @ rows.T
        scores[query_ids[at : at + _SLICE, None] == ids[None, :]] = -np.inf
        if open_ is not None:
            scores[~open_(at, at + _SLICE)] = -np.inf
        least = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)]
        for i in range(len(part)):
            near = np.flatnonzero((scores[i] >= least[i] - reach * np.abs(part[i]).max()) & (scores[i] > -np.inf))
            exact = (rows[near] * part[i]).sum(axis=1)
            order = np.lexsort((ids[near], -exact))[:k]
            found.append((query_ids[at + i], ids[near][order], exact[order]))
    return pd.DataFrame({
        "query_id": np.repeat([q for q, _, _ in found], [len(n) for _, n, _ in found]).astype(np.int64),
        "vec_id": np.concatenate([n for _, n, _ in found]) if found else np.zeros(0, np.int64),
        "score": np.concatenate([s for _, _, s in found]) if found else np.zeros(0)})


def packed(sizes: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """The bin of each part, and how many blocks each bin is cut into: parts in
    turn share a bin while they fit into one block."""
    bins, held, number = {}, 0, -1
    totals: dict[int, int] = {}
    for part, rows in sorted(sizes.items()):
        if number < 0 or held + rows > BLOCK_ROWS:
            number, held = number + 1, 0
        bins[part] = number
        held += rows
        totals[number] = held
    return bins, {b: -(-n // BLOCK_ROWS) for b, n in totals.items()}


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id,
    embedding) whose vec_id is divisible by ``every``, the k other rows with the
    largest inner product among the parts that are visited; ties go to the smaller
    vec_id. With k rows or fewer besides it, a query gets all of its parts.

    The partition is learned from SAMPLE_ROWS rows at most, those with the least
    hashes; every row is indexed. Small parts share a block of up to BLOCK_ROWS
    rows. A larger part is cut into blocks by the id's hash, as are the queries that
    visit it, so a part that a third of all rows fall into is many tasks. Rows that repeat a vec_id are one
    candidate for each row, and never the neighbours of their own id.
    """
    sound = cut_lineage(taking_part(vectors))
    spark = vectors.sparkSession
    total = sound.count()
    schema = "query_id long, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    sample = sound.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
    partition = learn(_matrix(sample.column(0).combine_chunks()), total, k, recall)
    if total <= SAMPLE_ROWS // 4:
        partition.probes = partition.parts
    index = _routed(sound, partition, 1).select("vec_id", "embedding", F.element_at("parts", 1).alias("part"))
    asking = _routed(sound.where(F.col("vec_id") % every == 0), partition, partition.probes).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "parts")
    index, asking = cut_lineage(index), cut_lineage(asking)
    # A row for each part: PART_SAMPLE bounds their number.
    bins, blocks = packed({r["part"]: r["count"] for r in index.groupBy("part").count().collect()})
    bin_of = F.create_map(*[F.lit(x) for pair in bins.items() for x in pair])
    visits = asking.select("query_id", "query", "parts", F.explode(
        F.array_distinct(F.filter(F.transform("parts", lambda p: bin_of[p]), lambda b: b.isNotNull()))).alias("bin"))
    query_blocks = {r["bin"]: -(-r["count"] // BLOCK_ROWS) for r in visits.groupBy("bin").count().collect()}
    if not query_blocks:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    row_count = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])[F.col("bin")]
    query_count = F.coalesce(F.create_map(*[F.lit(x) for pair in query_blocks.items() for x in pair])[F.col("bin")], F.lit(0))

    def block(key: str, count):
        return F.pmod(F.xxhash64(key), count).cast("int")

    def every_block(count):
        return F.explode(F.sequence(F.lit(0), count - 1))

    placed = index.withColumn("bin", bin_of[F.col("part")]).where(query_count > 0)
    left = placed.select("bin", block("vec_id", row_count).alias("row_block"), every_block(query_count).alias("query_block"),
                         "part", "vec_id", "embedding")
    right = visits.select("bin", every_block(row_count).alias("row_block"), block("query_id", query_count).alias("query_block"),
                          "parts", "query_id", "query")
    parts = partition.parts

    def meet(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        wanted = np.zeros((len(asked), parts), bool)
        np.put_along_axis(wanted, _matrix(asked["parts"]).astype(np.int64), True, axis=1)
        part = own["part"].to_numpy()
        return best_in_block(asked["query_id"].to_numpy(), _matrix(asked["query"]), own["vec_id"].to_numpy(), _matrix(own["embedding"]),
                             k, lambda a, b: wanted[a:b][:, part])

    keys = ["bin", "row_block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)
    ranked = top_k(found, "query_id", [F.desc("score"), F.asc("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
