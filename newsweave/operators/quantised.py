"""Approximate search over two levels of cells with product-quantised residuals.

An article lies in the cell of its nearest centroid: first among the coarse ones,
then among the fine ones below that. What is left, vector less centroid, is cut
into short pieces, and each piece is stored as the number of the nearest entry of
a learned codebook: one byte a piece. A search reads the folders of the cells it
visits, adds up table entries for a short list, and only for that reads vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsweave.constants import TOP_K
from newsweave.functions.vectors import unit_vector
from newsweave.operators.joins import lookup_join
from newsweave.operators.ranking import top_k
from newsweave.operators.similarity import SCORE_DECIMALS, _Best, _first_of, _matrix, fingerprint, top_articles, usable
from newsweave.session import cut_lineage, stored
from newsweave.sinks.versions import path_exists

# Centroids and codebooks are learned on about this many rows, chosen by a hash of the id.
SAMPLE_ROWS = 1 << 18
LLOYD_ROUNDS = 8
PIECES = 8
ENTRIES = 256
# Sampled rows for each codebook entry at least.
ROWS_PER_ENTRY = 4
# Articles of a stored file.
FILE_ROWS = 65_536
# Articles whose vectors a task holds at a time, how many times as many it holds by
# their codes alone, users that meet them, users whose estimates are made together, and
# bytes of vectors that are scored together.
BLOCK_ROWS = 65_536
CODE_BLOCKS = 16
USER_BLOCK_ROWS = 1 << 17
SLICE_ROWS = 2048
PAIR_BYTES = 16 << 20
# A block of users is not cut below this only to have work for all cores.
LEAST_USER_ROWS = 1024
# Users on which the number of cells to visit is measured.
MEASURED_USERS = 256
# Articles of a user whose estimates are checked exactly.
SHORT = 20 * TOP_K


@dataclass(frozen=True)
class QuantisedIndex:
    """``articles``: part, cell, news_id, codes, embedding (length 1), stored by part,
    which is the coarse cell. ``parent`` is each fine cell's coarse one."""

    articles: DataFrame
    coarse: np.ndarray
    fine: np.ndarray
    parent: np.ndarray
    books: np.ndarray


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (vectors @ centroids.T - 0.5 * (centroids**2).sum(axis=1)).argmax(axis=1)


def lloyd(vectors: np.ndarray, k: int, rounds: int = LLOYD_ROUNDS) -> np.ndarray:
    """Up to ``k`` centroids, from evenly spaced distinct rows on. One without rows stays where it was."""
    distinct = np.unique(vectors, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = _nearest(vectors, centroids)
        order = np.argsort(near, kind="stable")
        heads = np.flatnonzero(np.append(True, near[order][1:] != near[order][:-1]))
        sums = np.add.reduceat(vectors[order], heads, axis=0)
        centroids = centroids.copy()
        centroids[near[order][heads]] = sums / np.diff(np.append(heads, len(order)))[:, None]
    return centroids


def _learned(rows: DataFrame, key: str, k: int) -> dict[int, np.ndarray]:
    """Centroids per ``key`` of the sample ``rows`` (key, news_id, x), each learned by one task."""

    def learn(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.vstack(pdf.sort_values("news_id")["x"].to_numpy()).astype("float64")
        return pd.DataFrame({key: group[0], "x": list(lloyd(vectors, k))})

    found = rows.groupBy(key).applyInPandas(learn, f"{key} int, x array<double>").toPandas()
    return {int(g): np.vstack(own["x"].to_numpy()) for g, own in found.groupby(key)}


def _placed(coarse: np.ndarray, fine: np.ndarray, parent: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The fine cell of each vector: of those below the nearest coarse centroid the nearest."""
    part, cell = _nearest(vectors, coarse), np.zeros(len(vectors), np.int64)
    for p in np.unique(part).tolist():
        rows, own = np.flatnonzero(part == p), np.flatnonzero(parent == p)
        cell[rows] = own[_nearest(vectors[rows], fine[own])]
    return cell


def _codes(books: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """(row, piece) entry numbers of the residuals."""
    cut = residuals.reshape(len(residuals), len(books), -1)
    return np.stack([_nearest(cut[:, i], books[i]) for i in range(len(books))], axis=1).astype(np.uint8)


def build(articles: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS) -> QuantisedIndex:
    """Learn an index of ``articles`` (news_id, embedding) and store it below ``path``.

    There are about as many cells as the square root of the number of articles, in
    as many parts as the root of that; so both grow with the table. Vectors that are
    null or not finite take no part. What reaches the driver are centroids and codebooks.
    """
    spark = articles.sparkSession
    unit = cut_lineage(usable(articles, "embedding").select("news_id", unit_vector(F.col("embedding")).alias("embedding")))
    count = unit.count()
    if not count:
        raise ValueError("an index needs at least one vector")
    share = min(1.0, sample_rows / count)
    sample = cut_lineage(unit.where(F.pmod(F.xxhash64("news_id"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))))
    dimension = len(unit.first()["embedding"])
    pieces = max(p for p in range(1, PIECES + 1) if dimension % p == 0)
    cells = int(np.ceil(np.sqrt(count)))
    parts = int(np.ceil(np.sqrt(cells)))
    one = sample.select(F.lit(0).alias("part"), "news_id", F.col("embedding").alias("x"))
    coarse = _learned(one, "part", parts).get(0)
    if coarse is None:
        coarse = np.array([unit.first()["embedding"]])

    def rows_of(function, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield function(batch, _matrix(batch.column(1)))

        return sample.mapInArrow(run, schema)

    id_type = articles.schema["news_id"].dataType.simpleString()
    lists = pa.list_(pa.float64())
    by_part = rows_of(lambda b, v: pa.RecordBatch.from_arrays(
        [pa.array(_nearest(v, coarse), pa.int32()), b.column(0), b.column(1)], ["part", "news_id", "x"]),
        f"part int, news_id {id_type}, x array<double>")
    below = _learned(by_part, "part", -(-cells // len(coarse)))
    # A coarse cell that no sampled row is in is its own fine cell.
    groups = [below.get(p, coarse[p : p + 1]) for p in range(len(coarse))]
    fine, parent = np.vstack(groups), np.repeat(np.arange(len(groups)), [len(g) for g in groups])

    def residual_pieces(batch: pa.RecordBatch, vectors: np.ndarray) -> pa.RecordBatch:
        left = (vectors - fine[_placed(coarse, fine, parent, vectors)]).reshape(len(vectors) * pieces, -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(pieces), len(vectors)), pa.int32()), batch.column(0).take(pa.array(np.repeat(np.arange(len(vectors)), pieces))),
             pa.array(list(left), lists)], ["piece", "news_id", "x"])

    entries = max(min(ENTRIES, sample.count() // ROWS_PER_ENTRY), 1)
    learned = _learned(rows_of(residual_pieces, f"piece int, news_id {id_type}, x array<double>"), "piece", entries)
    books = np.zeros((pieces, entries, dimension // pieces))
    for piece, found in learned.items():
        # Entries that are not needed repeat the first one, which is chosen before them.
        books[piece] = found[0]
        books[piece, : len(found)] = found

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(1))
                cell = _placed(coarse, fine, parent, vectors)
                codes = _codes(books, vectors - fine[cell])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parent[cell], pa.int32()), pa.array(cell, pa.int32()), batch.column(0),
                     pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], ["part", "cell", "news_id", "codes", "embedding"])

    encoded = cut_lineage(unit.mapInArrow(encode, f"part int, cell int, news_id {id_type}, codes binary, embedding array<double>"))
    # Files of about FILE_ROWS articles; the table of sizes has a row for each part.
    sizes = encoded.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("_files"))
    filed = encoded.join(F.broadcast(sizes), "part").withColumn("_file", F.pmod(F.xxhash64("news_id"), F.col("_files")))
    filed.repartition("part", "_file").drop("_file", "_files").sortWithinPartitions("part", "cell").write.partitionBy("part").parquet(f"{path}/articles")
    rows = [("coarse", i, None, row.tolist()) for i, row in enumerate(coarse)]
    rows += [("fine", i, int(p), row.tolist()) for i, (p, row) in enumerate(zip(parent, fine))]
    rows += [("book", i, None, book.reshape(-1).tolist()) for i, book in enumerate(books)]
    # Written last: an index without it is not complete.
    spark.createDataFrame(rows, "kind string, number int, parent int, x array<double>").coalesce(1).write.parquet(f"{path}/learned")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> QuantisedIndex:
    """A stored index."""
    rows = spark.read.parquet(f"{path}/learned").toPandas().sort_values("number")
    held = {kind: np.vstack(own["x"].to_numpy()) for kind, own in rows.groupby("kind")}
    parent = rows.loc[rows["kind"] == "fine", "parent"].to_numpy(np.int64)
    pieces = len(held["book"])
    books = held["book"].reshape(pieces, -1, held["fine"].shape[1] // pieces)
    articles = spark.read.parquet(f"{path}/articles").select("part", "cell", "news_id", "codes", "embedding")
    return QuantisedIndex(articles, held["coarse"], held["fine"], parent, books)


def load_or_build(articles: DataFrame, path: str) -> QuantisedIndex:
    """The stored index of exactly these articles, built where there is none."""
    folder = f"{path}/{fingerprint(articles).replace(':', '-')}"
    if path_exists(articles.sparkSession, f"{folder}/learned/_SUCCESS"):
        return load(articles.sparkSession, folder)
    return build(articles, folder)


def _unit_users(users: DataFrame) -> DataFrame:
    return usable(users.select("user_id", "user_embedding"), "user_embedding").select(
        "user_id", unit_vector(F.col("user_embedding")).alias("user_embedding"))


def _best_cells(index: QuantisedIndex, vectors: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the ``probes`` cells with the greatest products, sought among the
    fine cells of four times as many coarse ones as they would fill."""
    each = max(len(index.fine) // len(index.coarse), 1)
    wide = min(len(index.coarse), 4 * -(-probes // each) + 1)
    parts = np.argpartition(-(vectors @ index.coarse.T), wide - 1, axis=1)[:, :wide]
    scores = np.full((len(vectors), len(index.fine)), -np.inf)
    for p in np.unique(parts).tolist():
        rows, own = np.flatnonzero((parts == p).any(axis=1)), np.flatnonzero(index.parent == p)
        scores[np.ix_(rows, own)] = vectors[rows] @ index.fine[own].T
    most = min(probes, len(index.fine))
    cells = np.argsort(-scores, axis=1, kind="stable")[:, :most]
    rows = np.repeat(np.arange(len(vectors)), most)
    found = np.isfinite(scores[rows, cells.reshape(-1)])
    return rows[found], cells.reshape(-1)[found]


def _blocks(index: QuantisedIndex, block_rows: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The first block and the number of blocks of each cell, and how many articles
    there are. Neighbouring cells share a block up to ``block_rows`` articles (BLOCK_ROWS
    if None); a larger cell has several of its own. A row for each cell reaches the driver."""
    block_rows = block_rows or BLOCK_ROWS
    first, many, held, number = np.zeros(len(index.fine), np.int64), np.zeros(len(index.fine), np.int64), 0, 0
    counts = {r["cell"]: r["count"] for r in index.articles.groupBy("cell").count().collect()}
    for cell in sorted(counts):
        own = -(-counts[cell] // block_rows)
        if held and (own > 1 or held + counts[cell] > block_rows):
            number, held = number + 1, 0
        first[cell], many[cell] = number, own
        number, held = (number + own, 0) if own > 1 else (number, held + counts[cell])
    return first, many, sum(counts.values())


def _visits(users: DataFrame, index: QuantisedIndex, probes: int, first: np.ndarray, many: np.ndarray) -> DataFrame:
    """(block, user_id, cells, user_embedding): a row for each block of articles in which
    a user visits cells, with all of these. So a vector is repeated once for each
    block, not for each cell."""
    shared = users.sparkSession.sparkContext.broadcast((QuantisedIndex(None, index.coarse, index.fine, index.parent, index.books), first, many))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, first, many = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, cells = _best_cells(index, _matrix(part.column(1)), probes)
                # A cell without articles has no block, one of several is in each.
                rows, cells = np.repeat(rows, many[cells]), np.repeat(cells, many[cells])
                if not len(rows):
                    continue
                order = np.lexsort((cells, rows))
                rows, cells = rows[order], cells[order]
                heads = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (cells[1:] != cells[:-1])))
                place = np.arange(len(rows)) - np.repeat(heads, np.diff(np.append(heads, len(rows))))
                block = first[cells] + place
                order = np.lexsort((cells, block, rows))
                rows, cells, block = rows[order], cells[order], block[order]
                heads = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (block[1:] != block[:-1])))
                at = pa.array(rows[heads])
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(rows)), pa.int32()), pa.array(cells, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[heads], pa.int32()), part.column(0).take(at), lists, part.column(1).take(at)],
                    ["block", "user_id", "cells", "user_embedding"])

    kind = users.schema["user_id"].dataType.simpleString()
    return users.mapInArrow(choose, f"block int, user_id {kind}, cells array<int>, user_embedding array<double>")


def _exact(users: np.ndarray, rows: np.ndarray, articles: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The cosine of each pair of a user and an article, a few of them at a time."""
    found = np.empty(len(rows))
    step = max(PAIR_BYTES // (8 * articles.shape[1]), 1)
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        found[part] = np.einsum("ij,ij->i", articles[columns[part]], users[rows[part]])
    return np.round(found, SCORE_DECIMALS) + 0.0


def _copies(ids: pa.Array, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in an order in which those with the same id and part are together, and for
    each row where its like begin there and how many they are."""
    number = ids.dictionary_encode().indices.to_numpy()
    order = np.lexsort((part, number))
    heads = np.flatnonzero(np.append(True, (number[order][1:] != number[order][:-1]) | (part[order][1:] != part[order][:-1])))
    sizes = np.diff(np.append(heads, len(order)))
    begin, copies = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    begin[order], copies[order] = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    return order, begin, copies


def _user_blocks(users: DataFrame, blocks: int) -> int:
    """Into how many blocks users are dealt that meet ``blocks`` of articles."""
    count = users.count()
    idle = -(-2 * users.sparkSession.sparkContext.defaultParallelism // max(blocks, 1))
    return max(-(-count // USER_BLOCK_ROWS), min(-(-count // LEAST_USER_ROWS), idle), 1)


def _meeting(sides: tuple[DataFrame, DataFrame], score, keys: list[str], schema: T.StructType) -> DataFrame:
    """``score(articles, users)`` over every block: the rows of the first side are held as
    one table, in order of id, and those of the second stream past them."""
    meeting = sides[0].unionByName(sides[1], allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "kind", "news_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], None
        for batch in batches:
            marks = np.column_stack([np.asarray(batch.column(c)) for c in (*keys, "kind")])
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows]):
                if start == end:
                    continue
                part, mark = batch.slice(start, end - start), tuple(marks[start])
                if mark[:-1] != block:
                    block, parts, held = mark[:-1], [], None
                if mark[-1] == 0:
                    parts.append(part)
                    continue
                if held is None and not parts:
                    continue
                if held is None:
                    held, parts = score(pa.Table.from_batches(parts).combine_chunks()), []
                for at in range(0, part.num_rows, SLICE_ROWS):
                    yield from held(part.slice(at, SLICE_ROWS))

    return meeting.mapInArrow(run, schema)


def _spread_ids(ids: pa.Array, part: np.ndarray, own: np.ndarray, copies) -> tuple[np.ndarray, np.ndarray]:
    """The rows that those at ``own`` stand for, and whose of them each is."""
    order, begin, many = copies
    ends = np.append(0, np.cumsum(many[own]))
    of = np.repeat(np.arange(len(own)), many[own])
    return order[np.repeat(begin[own] - ends[:-1], many[own]) + np.arange(ends[-1])], of


def _shortlists(users: DataFrame, index: QuantisedIndex, probes: int, short: int, k: int) -> DataFrame:
    """(user_id, news_id, estimate, scores) of the ``k`` best articles by cosine of each user
    and block of vectors, among the ``short`` best by added table entries of all that the user
    visits. Rows that repeat an id in a part stand for each other, so each of them has the
    cosines of all in its block.

    A task holds the articles of one block, and users stream past it. Where no more than
    ``short`` articles exist, all of them are on the short list of their user, and the vectors
    are there at once. Else only cells and codes are dealt out, so that many articles are one
    block and a user's list leaves it whole; then users meet the vectors that they list.
    """
    spark = users.sparkSession
    first, many, count = _blocks(index)
    whole = count <= short
    if not whole:
        first, many, _ = _blocks(index, CODE_BLOCKS * BLOCK_ROWS)
    vector_blocks = -(-count // BLOCK_ROWS)
    visits = stored(_visits(users, index, probes, first, many), "visits")
    # A row for each cell at most; folders of other parts are not read.
    cells = [row[0] for row in visits.select(F.explode("cells")).distinct().collect()]
    near = index.articles.where(F.col("part").isin(sorted(set(index.parent[cells].tolist()))))
    placing = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first, many)) if b], "cell int, _first int, _many int")
    # A vector meets lists where its id is dealt, so rows that repeat an id are together.
    dealt = F.pmod(F.xxhash64("news_id"), F.lit(vector_blocks)).cast("int")
    kinds = {"user_id": users.schema["user_id"].dataType, "news_id": index.articles.schema["news_id"].dataType}
    blocks = int((first + many)[many > 0].max(initial=1))
    user_blocks = _user_blocks(users, blocks)
    each = F.explode(F.sequence(F.lit(0), F.lit(user_blocks - 1)))
    keys = ["block", "_user_block"]
    articles = near.join(F.broadcast(placing), "cell").select(
        (F.col("_first") + F.pmod(F.xxhash64("news_id"), F.col("_many")).cast("int")).alias("block"), each.alias("_user_block"),
        F.lit(0).alias("kind"), "news_id", "codes", "cell", *([F.col("embedding").alias("vector")] if whole else [dealt.alias("_dealt")]))
    visitors = visits.select(
        "block", F.pmod(F.xxhash64("user_id"), F.lit(user_blocks)).cast("int").alias("_user_block"),
        F.lit(1).alias("kind"), "user_id", "cells", F.col("user_embedding").alias("vector"))
    fields = [T.StructField("user_id", kinds["user_id"]), T.StructField("news_id", kinds["news_id"]), T.StructField("estimate", T.DoubleType()),
              T.StructField("scores", T.ArrayType(T.DoubleType()))]
    schema, doubles, ints = T.StructType(fields), T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())
    lists = T.StructType([
        T.StructField("user_id", kinds["user_id"]), T.StructField("user_embedding", doubles), T.StructField("estimates", doubles),
        T.StructField("ids", T.ArrayType(kinds["news_id"])), T.StructField("parts", ints), T.StructField("places", ints)])
    shared = spark.sparkContext.broadcast((index.fine, index.books, index.parent))

    def estimated(held: pa.Table):
        """What a task that holds ``held`` articles makes of users that visit some cells."""
        fine, books, parent = shared.value
        ids, cell = held["news_id"].combine_chunks(), held["cell"].to_numpy()
        codes = np.frombuffer(b"".join(held["codes"].to_pylist()), np.uint8).reshape(-1, len(books))
        items = _matrix(held["vector"]) if whole else None
        copies = _copies(ids, parent[cell]) if whole else None
        order = np.argsort(cell, kind="stable")
        heads = np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1]))
        places = {int(cell[own[0]]): own for own in np.split(order, heads[1:])}
        place = None if whole else held["_dealt"].to_numpy()

        def lists_of(few: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            vectors, cells = _matrix(few.column("vector")), few.column("cells")
            owner, cells = np.repeat(np.arange(few.num_rows), pc.list_value_length(cells).to_numpy()), np.asarray(cells.flatten())
            best = _Best(len(vectors), k if whole else short)
            by_cell = np.argsort(cells, kind="stable")
            for rows in np.split(by_cell, np.flatnonzero(cells[by_cell][1:] != cells[by_cell][:-1]) + 1) if len(by_cell) else ():
                c, rows = int(cells[rows[0]]), owner[rows]
                own = places.get(c)
                if own is None:
                    continue
                # A product with what the codes stand for adds up their table entries.
                back = np.hstack([book[codes[own, p]] for p, book in enumerate(books)]) + fine[c]
                mine = vectors if len(rows) == len(vectors) else vectors[rows]
                for start in range(0, len(own), BLOCK_ROWS):
                    some = own[start : start + BLOCK_ROWS]
                    estimates = mine @ back[start : start + BLOCK_ROWS].T
                    if not whole:
                        best.add(estimates, some, rows)
                        continue
                    like, of = _spread_ids(ids, parent, some, copies)
                    best.add(mine @ items[like].T, some[of], rows, estimates if len(of) == len(some) else estimates[:, of])
            rows, columns, values, *beside = best.found()
            if whole:
                yield pa.RecordBatch.from_arrays(
                    [few.column("user_id").take(pa.array(rows)), ids.take(pa.array(columns)), pa.array(beside[0]),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1), pa.int32()), pa.array(values))], names=schema.names)
                return
            ends = pa.array(np.searchsorted(rows, np.arange(few.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [few.column("user_id"), few.column("vector"), *(pa.ListArray.from_arrays(ends, x) for x in (
                    pa.array(values), ids.take(pa.array(columns)), pa.array(parent[cell[columns]], pa.int32()), pa.array(place[columns], pa.int32())))],
                names=lists.names)

        return lists_of

    found = _meeting((articles, visitors), estimated, keys, schema if whole else lists)
    if whole:
        return found
    if blocks > 1:
        # A user's lists of all blocks become one.
        entries = F.transform(F.arrays_zip("estimates", "ids", "parts", "places"), lambda x: F.struct(
            (-x["estimates"]).alias("less"), x["ids"].alias("ids"), x["parts"].alias("parts"), x["places"].alias("places")))
        merged = found.withColumn("entries", entries).groupBy("user_id", F.xxhash64("user_embedding").alias("_vector")).agg(
            F.any_value("user_embedding").alias("user_embedding"),
            F.slice(F.array_sort(F.flatten(F.collect_list("entries"))), 1, short).alias("entries"))
        found = merged.select("user_id", "user_embedding", F.transform("entries", lambda x: -x["less"]).alias("estimates"),
                              *[F.col(f"entries.{c}").alias(c) for c in ("ids", "parts", "places")])

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of vectors that has articles of a user's list."""
        for batch in batches:
            user = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("places")).to_numpy())
            block = np.asarray(batch.column("places").flatten())
            order = np.lexsort((block, user))
            user, block = user[order], block[order]
            heads = np.flatnonzero(np.append(len(user) > 0, (user[1:] != user[:-1]) | (block[1:] != block[:-1])))
            ends, at = pa.array(np.append(heads, len(user)), pa.int32()), pa.array(user[heads])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[heads], pa.int32()), batch.column("user_id").take(at), batch.column("user_embedding").take(at),
                 *(pa.ListArray.from_arrays(ends, batch.column(c).flatten().take(pa.array(order))) for c in ("estimates", "ids", "parts"))],
                names=["block", "user_id", "vector", "estimates", "ids", "parts"])

    listed = found.mapInArrow(by_block, T.StructType([
        T.StructField("block", T.IntegerType()), fields[0], T.StructField("vector", doubles), *lists.fields[2:5]]))
    user_blocks = _user_blocks(users, vector_blocks)
    each = F.explode(F.sequence(F.lit(0), F.lit(user_blocks - 1)))
    vectors = near.select(dealt.alias("block"), each.alias("_user_block"), F.lit(0).alias("kind"), "news_id", "part", F.col("embedding").alias("vector"))
    listed = listed.withColumn("_user_block", F.pmod(F.xxhash64("user_id"), F.lit(user_blocks)).cast("int")).withColumn("kind", F.lit(1))

    def scored(held: pa.Table):
        """What a task that holds the vectors of ``held`` articles makes of short lists."""
        ids, part, items = held["news_id"].combine_chunks(), held["part"].to_numpy(), _matrix(held["vector"])
        copies = _copies(ids, part)
        # The rows are in order of id; a list names the id and the part of one.
        known = ids.dictionary_encode()
        number = known.indices.to_numpy().astype(np.int64) * (int(part.max()) + 1) + part
        order = np.argsort(number, kind="stable")

        def scores_of(few: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            user = np.repeat(np.arange(few.num_rows), pc.list_value_length(few.column("ids")).to_numpy())
            at = pc.index_in(few.column("ids").flatten(), known.dictionary).to_numpy().astype(np.int64)
            at = at * (int(part.max()) + 1) + np.asarray(few.column("parts").flatten())
            row = order[np.searchsorted(number[order], at)]
            like, of = _spread_ids(ids, part, row, copies)
            exact = _exact(_matrix(few.column("vector")), user[of], items, like)
            estimates = np.asarray(few.column("estimates").flatten())
            keep = _first_of(user[of], row[of], exact, k)[0]
            yield pa.RecordBatch.from_arrays(
                [few.column("user_id").take(pa.array(user[of][keep])), ids.take(pa.array(row[of][keep])), pa.array(estimates[of][keep]),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1), pa.int32()), pa.array(exact[keep]))], names=schema.names)

        return scores_of

    return _meeting((vectors, listed), scored, keys, schema)


def search(users: DataFrame, index: QuantisedIndex, k: int = TOP_K, probes: int = 8, short: int = SHORT) -> DataFrame:
    """user_id, news_id, similarity_score, rank: of the ``short`` articles with the best
    estimates in the ``probes`` cells closest to a user, the ``k`` best by exact
    cosine, ties to the lower id. Fewer than ``k`` rows are possible. Articles without
    an id are not found."""
    users = cut_lineage(_unit_users(users).where("user_id is not null"))
    near = index.articles.where("news_id is not null")
    held = QuantisedIndex(near, index.coarse, index.fine, index.parent, index.books)
    listed = _shortlists(users, held, probes, max(short, k), k).select("user_id", "news_id", F.explode("scores").alias("similarity_score"))
    return top_k(listed, "user_id", [F.desc("similarity_score"), F.col("news_id")], k)


def measured_probes(users: DataFrame, articles: DataFrame, index: QuantisedIndex, k: int = TOP_K, recall: float = 0.97) -> int:
    """The least number of cells in which ``recall`` of the exact ``k`` best articles
    lie, over MEASURED_USERS users with the least hashes of their ids."""
    sample = cut_lineage(_unit_users(users).orderBy(F.xxhash64("user_id"), "user_id").limit(MEASURED_USERS))
    exact = top_articles(sample, articles, k).select("user_id", "news_id")
    cells = lookup_join(exact, index.articles.select("news_id", "cell"), "news_id")
    # At most k rows for each of the few users.
    held = lookup_join(cells, sample, "user_id").select("user_embedding", "cell").toPandas()
    if held.empty:
        return 1
    vectors, cell = np.vstack(held["user_embedding"].to_numpy()), held["cell"].to_numpy()
    scores = vectors @ index.fine.T
    place = (scores > scores[np.arange(len(cell)), cell][:, None]).sum(axis=1) + 1
    return int(np.sort(place)[int(np.ceil(recall * len(place))) - 1])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(users, wanted, hits, recall): how many of the ``exact`` rows were found."""
    hit = exact.select("user_id", "news_id").join(
        found.select("user_id", "news_id", F.lit(1).alias("_hit")), ["user_id", "news_id"], "left")
    return hit.agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("hits")).withColumn(
        "recall", F.col("hits") / F.col("wanted"))
