"""Packing of documents into token windows by lexical retrieval."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from newsweave.llm.tokencounts import PATTERN
from newsweave.session import new_folder

WINDOW = 1024
END = 0
# Items of one index shard, and about how many of them a task packs, shard after shard.
SHARD_ITEMS = 2048
TASK_ITEMS = 16_384
MOST_TASKS = 1 << 16
# The seed's rarest tokens that are looked up, and BM25's usual constants.
QUERY_TOKENS = 16
K1, B = 1.2, 0.75
_SHIFT = 1 << 36
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [part.split()[0] for part in _PIECES.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)


def _tokenized(docs: DataFrame, ranks: bytes) -> DataFrame:
    """Per document its full windows as finished pieces and what is left over, with
    the ids. The file's partition and the row's place in it name a row, so a task
    that runs again names it alike."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("row", pa.int64()), ("first", pa.int64()),
        ("crcs", pa.list_(pa.int64())), ("ids", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoder = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        row = full = TaskContext.get().partitionId() * _SHIFT
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encoder.encode_ordinary(text.as_py() or ""), END], np.uint32)
                whole = len(ids) // WINDOW
                crcs = [zlib.crc32(ids[i * WINDOW : (i + 1) * WINDOW].tobytes()) for i in range(whole)]
                rest = ids[whole * WINDOW :]
                rows.append((doc, whole * WINDOW, len(ids), row, full, crcs, rest.tobytes()))
                row, full = row + 1, full + whole
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, start long, doc_tokens long, row long, first long, crcs array<long>, ids binary")


def _statistics(rest: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, float]:
    """In how many of all items each token of the vocabulary stands, the number of
    items and their mean length. As large as the vocabulary, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, items, length = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            for data in batch.column(0):
                ids = np.frombuffer(data.as_py(), np.uint32)
                # A token that is repeated counts once here.
                held[ids] += 1
                items, length = items + 1, length + len(ids)
        token = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*token.tolist(), -1, -2], pa.int64()), pa.array([*held[token].tolist(), items, length], pa.int64())], ["token", "n"])

    frequency = np.zeros(vocabulary, np.int64)
    items = length = 0
    counted = rest.select("ids").mapInArrow(count, "token long, n long")
    for token, n in counted.groupBy("token").agg(F.sum("n").alias("n")).toArrow().to_pandas().itertuples(index=False):
        if token >= 0:
            frequency[token] = n
        elif token == -1:
            items = n
        else:
            length = n
    return frequency, items, length / max(items, 1)


@dataclass
class Item:
    """A document, or the part of one that is still to be placed."""

    doc: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray


@dataclass
class Shard:
    """An inverted index over up to SHARD_ITEMS items: for each token the items it
    stands in with their BM25 weights. Its statistics are those of the whole corpus."""

    items: list[Item]
    idf: np.ndarray
    mean: float
    kinds: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        pairs = [np.unique(x.ids, return_counts=True) for x in self.items]
        self.kinds = [p[0] for p in pairs]
        owner = np.repeat(np.arange(len(pairs)), [len(k) for k in self.kinds])
        token = np.concatenate(self.kinds) if pairs else np.zeros(0, np.uint32)
        often = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0)
        size = np.array([len(x.ids) for x in self.items], float)
        norm = K1 * (1 - B + B * size / max(self.mean, 1e-9))
        weight = self.idf[token] * often * (K1 + 1) / (often + norm[owner])
        order = np.argsort(token, kind="stable")
        self.token, self.owner, self.weight = token[order], owner[order], weight[order]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused items that share one of the seed's rarest tokens, best score first,
        ties to the earlier item."""
        kinds = self.kinds[seed]
        rarest = kinds[np.argsort(-self.idf[kinds], kind="stable")[:QUERY_TOKENS]]
        low, high = np.searchsorted(self.token, rarest), np.searchsorted(self.token, rarest, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
        scores = np.bincount(self.owner[at], self.weight[at], len(self.items))
        found = np.flatnonzero((scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(items: list[Item], idf: np.ndarray, mean: float) -> tuple[list[list[Item]], list[Item]]:
    """Full windows of parts of the items, and the parts that fill no window.

    The longest unused item is the seed. Its nearest unused neighbours follow, best
    first, as far as they fit whole; then the best of the others is cut to fill the
    window, and its rest is unused again. Without neighbours the longest go in.
    """
    shard = Shard(items, idf, mean)
    left = np.array([len(x.ids) for x in items], np.int64)
    taken = np.zeros(len(items), np.int64)
    unused = left > 0
    windows, total = [], int(left.sum())

    def part(number: int, size: int) -> Item:
        item, at = items[number], int(taken[number])
        taken[number] += size
        left[number] -= size
        unused[number] = left[number] > 0
        return Item(item.doc, item.start + at, item.doc_tokens, item.ids[at : at + size])

    while total >= WINDOW:
        seed = int(left.argmax())
        window, gap = [], WINDOW
        gap -= int(left[seed])
        window.append(part(seed, int(left[seed])))
        cut = None
        for number in shard.neighbours(seed, unused).tolist():
            if not gap:
                break
            if left[number] <= gap:
                gap -= int(left[number])
                window.append(part(number, int(left[number])))
            elif cut is None:
                cut = number
        while gap:
            if cut is None or not unused[cut]:
                cut = int(left.argmax())
            size = min(gap, int(left[cut]))
            gap -= size
            window.append(part(cut, size))
        windows.append(window)
        total -= WINDOW
    return windows, [part(i, int(left[i])) for i in np.flatnonzero(unused).tolist()]


def pack(docs: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece of
    ``docs`` (doc_id, text; other columns are not looked at): where ``length`` ids of a
    document from ``start`` on lie. ``ranks`` is the file of a byte-level BPE.

    A document's ids end with END; every id lies in one piece, and a sequence holds at
    most WINDOW ids without gaps. Full windows of long documents stand alone. What is
    left over of each document is an item. Items with the same rarest token (by the
    whole corpus) go to one task, or to several by row if it is a frequent one. In the
    order of their two rarest tokens a task indexes SHARD_ITEMS at a time, and what
    fills no window goes on to its next shard. So each task leaves at most one
    sequence that is not full.
    A null or empty text is the one id END. Rows that repeat an id, a null one too, are
    documents of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    vocabulary = max(int(line.split()[1]) for line in ranks.splitlines()) + 1
    path = new_folder(spark, "tokens")
    _tokenized(docs, ranks).write.parquet(path)
    table = spark.read.parquet(path)
    whole = table.where("size(crcs) > 0").select(
        "doc_id", "doc_tokens", "first", F.posexplode("crcs").alias("at", "crc")).select(
        "doc_id", (F.col("at") * WINDOW).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), "doc_tokens",
        # Even numbers are left to the tasks that pack.
        ((F.col("first") + F.col("at")) * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = table.where("octet_length(ids) > 0")
    frequency, items, mean = _statistics(rest, vocabulary)
    idf = np.log1p((items - frequency + 0.5) / (frequency + 0.5))
    shared = spark.sparkContext.broadcast((idf, mean))

    tasks = min(max(-(-items // TASK_ITEMS), 1), MOST_TASKS)
    # A token stands first in no more items than it stands in, so this many shares of it are small enough.
    shares = np.maximum(frequency // max(items // tasks // 4, 1), 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value[0]
        for batch in batches:
            keys, salts = [], []
            for data, row in zip(batch.column(4), batch.column(3).to_pylist()):
                ids = np.frombuffer(data.as_py(), np.uint32)
                weight = weights[ids]
                best = int(ids[weight.argmax()])
                second = int(ids[np.where(ids == best, -1.0, weight).argmax()])
                keys.append((best << 32) | second)
                salts.append(zlib.crc32(row.to_bytes(8, "little")) % int(shares[best]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(keys, pa.int64()), pa.array(salts, pa.int64())],
                                             ["doc_id", "start", "doc_tokens", "row", "ids", "key", "salt"])

    placed = rest.select("doc_id", "start", "doc_tokens", "row", "ids").mapInArrow(
        keyed, "doc_id long, start long, doc_tokens long, row long, ids binary, key long, salt long")
    placed = placed.repartition(tasks, F.shiftright("key", 32), "salt").sortWithinPartitions("key", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, length = shared.value
        number = TaskContext.get().partitionId() * _SHIFT
        waiting: list[Item] = []

        def rows(windows: list[list[Item]]) -> Iterator[tuple]:
            nonlocal number
            for window in windows:
                offset = 0
                for x in window:
                    yield x.doc, x.start, len(x.ids), zlib.crc32(x.ids.tobytes()), x.doc_tokens, number * 2, offset
                    offset += len(x.ids)
                number += 1

        for batch in batches:
            for doc, start, tokens, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                waiting.append(Item(doc, start, tokens, np.frombuffer(data, np.uint32)))
                if len(waiting) >= SHARD_ITEMS:
                    windows, waiting = pack_shard(waiting, weights, length)
                    yield _rows(list(rows(windows)))
        windows, waiting = pack_shard(waiting, weights, length)
        yield _rows(list(rows(windows + ([waiting] if waiting else []))))

    return whole.unionByName(placed.mapInArrow(run, _PIECES))
