"""Nearest articles to each user profile by cosine similarity.

Four ways, of which the first three give the same, exact result:

* the article matrix is small enough to broadcast: every task multiplies its
  own users with it, and users are not shuffled at all;
* beyond that, blocks of users meet blocks of articles;
* over an index, articles are grouped into cells around learned centroids. A
  user first searches the closest cell. A further cell is visited only if the
  angle between user and centroid, less the cell's own angle, could still beat
  the user's k-th best score (triangle inequality on the sphere);
* approximate: only the ``probes`` closest cells are visited.

Users meet articles through equi-joins on the cell, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from newsweave.constants import COARSE_CELLS, TOP_K
from newsweave.functions.vectors import array_to_vector, unit_vector, well_formed
from newsweave.operators.joins import table_bytes
from newsweave.operators.ranking import top_k
from newsweave.session import cut_lineage

# Scores are compared at this precision, so that the order in which a machine
# adds up a product never decides a rank. Ties go to the lower article id.
SCORE_DECIMALS = 9
SLICE_ROWS = 1024
# Bytes of scores that one product of users and articles may take.
PRODUCT_BYTES = 16 << 20
# Articles a task holds at a time, or more if their vectors take no more than these
# bytes, users that stream past them, and those that go through a product together.
BLOCK_ROWS = 32768
BLOCK_BYTES = 64 << 20
USER_BLOCK_ROWS = 1 << 17
STREAM_ROWS = 4096
# A block of users is not cut below this only to have work for all cores.
LEAST_USER_ROWS = 1024
# Largest article matrix that every Python worker holds on its own.
MATRIX_BYTES = 64 << 20


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    lengths[lengths == 0] = 1.0
    return matrix / lengths


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A list column without nulls as an n by d matrix of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten(), dtype="float64")
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


class _Best:
    """The ``k`` best columns of each of ``count`` rows, of products that come piece by
    piece. Only what reaches a row's ``k``-th best so far, or its ``floor``, is kept, so
    a piece costs little more than its product."""

    def __init__(self, count: int, k: int, floor: np.ndarray | None = None):
        self.count, self.k = count, k
        self.floor = np.full(count, -np.inf) if floor is None else floor.copy()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, columns: np.ndarray, rows: np.ndarray | None = None, beside: np.ndarray | None = None) -> None:
        """``scores`` of ``rows`` (all if None) and ``columns``; ``beside`` has the same
        shape, and its numbers are kept with the scores."""
        if not scores.size:
            return
        # Scores that are equal when rounded differ by no more than this.
        floor = (self.floor if rows is None else self.floor[rows]) - 1.5 * 10.0**-SCORE_DECIMALS
        found = np.flatnonzero(scores >= floor[:, None])
        if len(found) > 2 * self.k * len(scores):
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            found = np.flatnonzero(scores >= np.maximum(floor, kth - 1.5 * 10.0**-SCORE_DECIMALS)[:, None])
        row, column = np.divmod(found, scores.shape[1])
        part = (row if rows is None else rows[row], columns[column], np.round(scores.reshape(-1)[found], SCORE_DECIMALS) + 0.0)
        self.parts.append(part if beside is None else (*part, beside.reshape(-1)[found]))
        self.waiting += len(found)
        if self.waiting > max(2 * self.k * self.count, 1 << 14):
            self._merge()

    def _merge(self) -> None:
        whole = tuple(np.concatenate(x) for x in zip(*self.parts))
        keep, place = _first_of(*whole[:3], self.k)
        whole = tuple(x[keep] for x in whole)
        last = place == self.k - 1
        rows = whole[0][last]
        self.floor[rows] = np.maximum(self.floor[rows], whole[2][last])
        self.parts, self.waiting = [whole], 0

    def found(self) -> tuple[np.ndarray, ...]:
        """(row, column, score, and what was beside it), the best of a row first; ties go to
        the lower column."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
        self._merge()
        return self.parts[0]


def _best(
    users: np.ndarray, items: np.ndarray, k: int, most: int | None = None, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``k`` best columns for each row of
    ``users @ items.T``, best first; ties go to the lower column. The product is
    taken in pieces of at most PRODUCT_BYTES and ``most`` columns. Scores below a
    row's ``floor`` may be left out."""
    width = PRODUCT_BYTES // (8 * max(1, len(users)))
    width = max(k, width if most is None else min(most, width))
    best = _Best(len(users), k, floor)
    for start in range(0, len(items), width):
        part = items[start : start + width]
        best.add(users @ part.T, np.arange(start, start + len(part)))
    return best.found()[:3]


def _first_of(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the ``k`` best of each row are, best first, ties by column, and their places from 0."""
    order = np.lexsort((columns, -values, rows))
    sorted_rows = rows[order]
    place = np.arange(len(rows)) - np.searchsorted(sorted_rows, sorted_rows)
    keep = place < k
    return order[keep], place[keep]


def _first_k(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep, _ = _first_of(rows, columns, values, k)
    return rows[keep], columns[keep], values[keep]


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and finite; others have no similarity."""
    return vectors.filter(well_formed(F.col(column)))


def _result_schema(users: DataFrame, articles: DataFrame) -> T.StructType:
    return T.StructType([
        users.schema["user_id"], articles.schema["news_id"], T.StructField("similarity_score", T.DoubleType()),
    ])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, "user_id", [F.desc("similarity_score"), F.col("news_id")], k)


def _search_broadcast(users: DataFrame, articles: DataFrame, k: int) -> DataFrame:
    """Exact search with the whole (small) article matrix in every task."""
    context = users.sparkSession.sparkContext
    table = articles.select("news_id", "embedding").orderBy("news_id").toArrow()
    ids = table.column("news_id").combine_chunks()
    shared = context.broadcast((ids, _unit_rows(_matrix(table.column("embedding")))))
    schema = T.StructType([*_result_schema(users, articles).fields, T.StructField("rank", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        article_ids, items = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows, columns, values = _best(_unit_rows(_matrix(part.column(1))), items, k)
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)),
                        article_ids.take(pa.array(columns)),
                        pa.array(values),
                        pa.array(place + 1),
                    ],
                    names=schema.names,
                )

    return users.select("user_id", "user_embedding").mapInArrow(search, schema)


@dataclass(frozen=True)
class CellIndex:
    """Articles by cell. ``articles``: cell, news_id, embedding (length 1).
    ``centroids``: one row per cell, in cell order. ``cosines``: the lowest
    cosine between an article of the cell and its centroid."""

    articles: DataFrame
    centroids: np.ndarray
    cosines: np.ndarray


def _assigned(articles: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Articles at length 1 with their closest cell and its cosine."""
    schema = T.StructType([
        T.StructField("cell", T.IntegerType()),
        T.StructField("cosine", T.DoubleType()),
        articles.schema["news_id"],
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
    ])
    shared = articles.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            vectors = _unit_rows(np.vstack(batch["embedding"].to_numpy()).astype("float64"))
            scores = vectors @ shared.value.T
            cells = scores.argmax(axis=1)
            yield pd.DataFrame({
                "cell": cells.astype("int32"),
                "cosine": scores[np.arange(len(cells)), cells],
                "news_id": batch["news_id"],
                "embedding": list(vectors),
            })

    return articles.select("news_id", "embedding").mapInPandas(assign, schema)


def build_cells(articles: DataFrame, cells: int = COARSE_CELLS, seed: int = 42) -> CellIndex:
    """Learn ``cells`` centroids on the normalised vectors and group by them.
    Centroids and cell angles are at most ``cells`` rows."""
    unit = usable(articles, "embedding").select("news_id", unit_vector(F.col("embedding")).alias("embedding"))
    features = unit.select(array_to_vector("embedding").alias("features")).persist()
    model = KMeans(k=cells, seed=seed, featuresCol="features").fit(features)
    features.unpersist()
    return cells_around(articles, np.vstack(model.clusterCenters()))


def cells_around(articles: DataFrame, centroids: np.ndarray) -> CellIndex:
    """Articles grouped around given centroids, each in the cell of the closest."""
    unit = usable(articles, "embedding").select("news_id", unit_vector(F.col("embedding")).alias("embedding"))
    centroids = _unit_rows(centroids)
    # Written out once; every search reads it several times.
    assigned = cut_lineage(_assigned(unit, centroids))
    cosines = np.ones(len(centroids))
    for row in assigned.groupBy("cell").agg(F.min("cosine").alias("cosine")).collect():
        cosines[row["cell"]] = row["cosine"]
    return CellIndex(assigned.drop("cosine"), centroids, cosines)


def _user_cells(users: DataFrame, index: CellIndex, how: str, probes: int = 1) -> DataFrame:
    """The cells each user searches, one row each, users at length 1.

    ``how`` is "closest" for the ``probes`` closest cells, "reachable" for all
    cells but the closest that may hold a score of at least ``bound``, which goes with
    the row.
    """
    carried = [users.schema["user_id"], T.StructField("user_embedding", T.ArrayType(T.DoubleType()))]
    if how == "reachable":
        carried.append(T.StructField("bound", T.DoubleType()))
    schema = T.StructType([T.StructField("cell", T.IntegerType()), *carried])
    shared = users.sparkSession.sparkContext.broadcast((index.centroids, index.cosines))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, cosines = shared.value
        spread = np.arccos(np.clip(cosines, -1.0, 1.0))
        for batch in batches:
            if batch.empty:
                continue
            vectors = _unit_rows(np.vstack(batch["user_embedding"].to_numpy()).astype("float64"))
            scores = vectors @ centroids.T
            order = np.argsort(-scores, axis=1, kind="stable")
            if how == "closest":
                rows = np.repeat(np.arange(len(vectors)), min(probes, len(centroids)))
                cells = order[:, :probes].reshape(-1)
            else:
                # Of the cells but the closest, those that may still hold a better one.
                angle = np.arccos(np.clip(scores, -1.0, 1.0)) - spread
                reach = np.cos(np.maximum(angle, 0.0)) + 1e-6
                visit = reach >= batch["bound"].to_numpy()[:, None]
                # A profile without length scores 0 everywhere, whatever the angle.
                visit |= ~vectors.any(axis=1)[:, None]
                visit[np.arange(len(vectors)), order[:, 0]] = False
                rows, cells = np.nonzero(visit)
            for start in range(0, len(rows), SLICE_ROWS * 8):
                part = slice(start, start + SLICE_ROWS * 8)
                chosen = pd.DataFrame({
                    "cell": cells[part].astype("int32"),
                    "user_id": batch["user_id"].to_numpy()[rows[part]],
                    "user_embedding": list(vectors[rows[part]]),
                })
                yield chosen.assign(bound=batch["bound"].to_numpy()[rows[part]]) if how == "reachable" else chosen

    return users.mapInPandas(choose, schema)


def _search_cells(user_cells: DataFrame, index: CellIndex, k: int, block_rows: int) -> DataFrame:
    """The ``k`` best articles of every (user, cell) pair, before merging; of those whose
    score is below the ``bound`` of a user, if there is one, some may be left out.

    A cell with more articles or users than a block holds is cut into blocks by a hash
    of the id, and every user block meets every article block of its cell in one task.
    So what is shuffled doesn't depend on a small ``block_rows``. In the task, the
    articles come first and are held; the users stream past them in Arrow batches and
    are multiplied with ``block_rows`` articles at a time. A block has BLOCK_ROWS
    articles, ``block_rows`` if that is more, or as many as BLOCK_BYTES hold, and
    USER_BLOCK_ROWS users, or fewer where some cores had no work else. The block
    counts are one row per cell.
    """
    held_rows = max(block_rows, BLOCK_ROWS, BLOCK_BYTES // (8 * index.centroids.shape[1]))

    def blocks(df: DataFrame, rows: Column, out: str) -> DataFrame:
        return df.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows")).select("cell", rows.cast("int").alias(out))

    article_blocks = blocks(index.articles, F.ceil(F.col("_rows") / held_rows), "article_blocks")
    every_block = article_blocks.agg(F.sum("article_blocks")).first()[0] or 1
    shares = -(-2 * user_cells.sparkSession.sparkContext.defaultParallelism // every_block)
    user_blocks = F.greatest(F.ceil(F.col("_rows") / USER_BLOCK_ROWS), F.least(F.ceil(F.col("_rows") / LEAST_USER_ROWS), F.lit(shares)))
    counts = F.broadcast(article_blocks.join(blocks(user_cells, user_blocks, "user_blocks"), "cell"))
    bound = F.col("bound") if "bound" in user_cells.columns else F.lit(None).cast("double").alias("bound")

    def chosen(key: str, count: str):
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    schema = _result_schema(user_cells, index.articles)
    keys = ["cell", "user_block", "article_block"]
    articles = (
        index.articles.join(counts, "cell")
        .withColumn("article_block", chosen("news_id", "article_blocks"))
        .withColumn("user_block", every("user_blocks"))
        .select(*keys, F.lit(0).alias("kind"), F.lit(None).cast(schema["user_id"].dataType).alias("user_id"),
                "news_id", F.col("embedding").alias("vector"), F.lit(None).cast("double").alias("bound"))
    )
    users = (
        user_cells.join(counts, "cell")
        .withColumn("user_block", chosen("user_id", "user_blocks"))
        .withColumn("article_block", every("article_blocks"))
        .select(*keys, F.lit(1).alias("kind"), "user_id",
                F.lit(None).cast(schema["news_id"].dataType).alias("news_id"), F.col("user_embedding").alias("vector"), bound)
    )
    meeting = articles.unionByName(users).repartition(*keys).sortWithinPartitions(*keys, "kind", "news_id")
    names = schema.names

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, parts, matrix = None, [], [], None
        for batch in batches:
            marks = np.column_stack([np.asarray(batch.column(c)) for c in (*keys, "kind")])
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows]):
                if start == end:
                    continue
                part, mark = batch.slice(start, end - start), tuple(marks[start])
                if mark[:3] != block:
                    block, ids, parts, matrix = mark[:3], [], [], None
                if mark[3] == 0:
                    ids.append(part.column("news_id"))
                    parts.append(_matrix(part.column("vector")))
                    continue
                if not parts:
                    continue
                if matrix is None:
                    matrix, block_ids = np.vstack(parts), pa.concat_arrays(ids)
                for first in range(0, part.num_rows, STREAM_ROWS):
                    piece = part.slice(first, STREAM_ROWS)
                    floor = piece.column("bound").to_numpy(zero_copy_only=False).astype("float64")
                    floor = np.where(np.isnan(floor), -np.inf, floor)
                    rows, columns, values = _best(_matrix(piece.column("vector")), matrix, k, block_rows, floor)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("user_id").take(pa.array(rows)), block_ids.take(pa.array(columns)), pa.array(values)],
                        names=names,
                    )

    return meeting.mapInArrow(search, schema)


def search_approximate(
    users: DataFrame, index: CellIndex, k: int = TOP_K, probes: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Top ``k`` within the ``probes`` closest cells. Fewer than ``k`` rows per
    user are possible, since close cells may hold fewer articles."""
    users = usable(users.select("user_id", "user_embedding"), "user_embedding")
    chosen = cut_lineage(_user_cells(users, index, "closest", probes))
    # At most one row per cell; a stored index then reads no other folder.
    wanted = [row[0] for row in chosen.select("cell").distinct().collect()]
    near = replace(index, articles=index.articles.filter(F.col("cell").isin(wanted)))
    return _ranked(_search_cells(chosen, near, k, block_rows), k)


def search_blocks(users: DataFrame, articles: DataFrame, k: int = TOP_K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top ``k`` of articles too many to broadcast: every block of users
    meets every block of articles, and only the best of each meeting go on. In
    many dimensions nearly all cells stay within reach of every user, so nothing
    is gained by cells here."""
    unit = usable(users.select("user_id", "user_embedding"), "user_embedding").select(
        F.lit(0).alias("cell"), "user_id", unit_vector(F.col("user_embedding")).alias("user_embedding"))
    whole = usable(articles.select("news_id", "embedding"), "embedding").select(
        F.lit(0).alias("cell"), "news_id", unit_vector(F.col("embedding")).alias("embedding"))
    whole = cut_lineage(whole)
    some = whole.first()
    index = CellIndex(whole, np.zeros((1, max(len(some["embedding"]), 1) if some else 1)), np.ones(1))
    return _ranked(_search_cells(cut_lineage(unit), index, k, block_rows), k)


def search_exact(
    users: DataFrame, index: CellIndex, k: int = TOP_K, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact top ``k`` over the cells that can matter. Profiles and first hits
    are each used several times, so they are written out once."""
    users = cut_lineage(usable(users.select("user_id", "user_embedding"), "user_embedding"))
    closest = _user_cells(users, index, "closest")
    first = cut_lineage(_ranked(_search_cells(closest, index, k, block_rows), k))
    bounds = first.filter(F.col("rank") == k).select("user_id", F.col("similarity_score").alias("bound"))
    open_users = users.join(bounds, "user_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    others = _search_cells(_user_cells(open_users, index, "reachable"), index, k, block_rows)
    return _ranked(first.drop("rank").unionByName(others), k)


def top_articles(
    users: DataFrame,
    articles: DataFrame,
    k: int = TOP_K,
    budget: int = MATRIX_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact top ``k`` articles per user: user_id, news_id, similarity_score,
    rank. ``users``: user_id, user_embedding. ``articles``: news_id, embedding.
    Articles the user has read are not left out. Null vectors and such with
    components that aren't finite numbers take no part on either side."""
    users, articles = usable(users, "user_embedding"), usable(articles, "embedding")
    if table_bytes(articles.select("news_id", "embedding")) <= budget:
        return _search_broadcast(users, articles, k)
    return search_blocks(users, articles, k, block_rows)


def search_in_chunks(users: DataFrame, articles: DataFrame, path: str, chunks: int, k: int = TOP_K, **options) -> DataFrame:
    """:func:`top_articles` chunk by chunk of users, each stored below ``path``, so that a
    job that broke off goes on after the last chunk it finished. Chunks are cut by a
    hash of the user and belong to exactly these tables; a finished one has Spark's
    own mark of a complete write and is not searched again."""
    from newsweave.sinks.versions import path_exists

    spark = users.sparkSession
    marks = [fingerprint(t.select(F.col(a).alias("news_id"), F.col(b).alias("embedding"))) for t, a, b in (
        (users, "user_id", "user_embedding"), (articles, "news_id", "embedding"))]
    root = f"{path}/{'-'.join(marks).replace(':', '-')}-{k}-{chunks}"
    folders = [f"{root}/chunk-{number}" for number in range(chunks)]
    for number, folder in enumerate(folders):
        if not path_exists(spark, f"{folder}/_SUCCESS"):
            own = users.where(F.pmod(F.xxhash64("user_id"), F.lit(chunks)) == number)
            top_articles(own, articles, k, **options).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(*folders)


def fingerprint(articles: DataFrame) -> str:
    """Changes when an article or a vector does; independent of row order."""
    row = articles.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("news_id", "embedding").cast("decimal(38,0)")).alias("h"),
    ).first()
    return f"{row['n']}:{row['h']}"


def save_cells(index: CellIndex, path: str, mark: str) -> None:
    """Articles partitioned by cell, centroids, and the fingerprint ``mark``,
    which is written last."""
    spark = index.articles.sparkSession
    # Files of about BLOCK_ROWS articles; a row per cell tells how many that takes.
    sizes = index.articles.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_files"))
    placed = index.articles.join(F.broadcast(sizes), "cell").withColumn("_file", F.pmod(F.xxhash64("news_id"), F.col("_files")))
    placed.repartition("cell", "_file").drop("_files", "_file").write.mode("overwrite").partitionBy("cell").parquet(
        f"{path}/articles"
    )
    rows = [
        (cell, [float(x) for x in centroid], float(cosine))
        for cell, (centroid, cosine) in enumerate(zip(index.centroids, index.cosines))
    ]
    spark.createDataFrame(rows, "cell int, centroid array<double>, cosine double").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/centroids"
    )
    spark.createDataFrame([(mark,)], "fingerprint string").coalesce(1).write.mode("overwrite").parquet(f"{path}/mark")


def load_cells(spark: SparkSession, path: str) -> tuple[CellIndex, str]:
    """A saved index and its fingerprint. Searches read only the cell folders
    they join with."""
    mark = spark.read.parquet(f"{path}/mark").first()["fingerprint"]
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    articles = spark.read.parquet(f"{path}/articles").select("cell", "news_id", "embedding")
    centroids = np.array([r["centroid"] for r in rows])
    return CellIndex(articles, centroids, np.array([r["cosine"] for r in rows])), mark


def load_or_build_cells(
    articles: DataFrame, path: str, cells: int = COARSE_CELLS, seed: int = 42
) -> CellIndex:
    """The saved index for exactly these articles, built and saved when there
    is none. Each set of articles has its own folder below ``path``."""
    from newsweave.sinks.versions import path_exists

    spark = articles.sparkSession
    mark = f"{fingerprint(articles)}:{cells}:{seed}"
    folder = f"{path}/{mark.replace(':', '-')}"
    if not path_exists(spark, f"{folder}/mark/_SUCCESS"):
        save_cells(build_cells(articles, cells, seed), folder, mark)
    return load_cells(spark, folder)[0]
