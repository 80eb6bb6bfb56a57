"""Reversible line dedup: exact reference counts behind sharded cuckoo filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsweave.llm.common import free_name, per_batch
from newsweave.llm.cuckoo import CuckooFilter
from newsweave.operators.joins import lookup_join
from newsweave.session import cut_lineage, new_folder
from newsweave.sinks.versions import path_exists

_SPACES = b" \t\n\x0b\x0c\r"
# Keys a shard's filter is laid out for, and bytes of filters that may be broadcast.
SHARD_KEYS = 500_000
BROADCAST_BYTES = 64 << 20
# References that meet a shard's filter in one task, beyond that bound.
SHARD_ROWS = 5_000_000
# Frequent keys that go to every task with their last documents, 24 bytes each.
EXACT_KEYS = 1 << 20
_KEY = "k1 long, k2 long"
_STATE = "number long, version string, shards int"


def _code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def line_key(line: bytes, least: int) -> bytes | None:
    """128 bits that stand for a line's key, or None where the key is shorter than
    ``least`` code points. The key is the line without ASCII white space at its
    ends, A-Z lower-cased."""
    key = line.strip(_SPACES)
    if len(key) < least or _code_points(key) < least:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _maybe_held(first: np.ndarray, second: np.ndarray, filters: list[bytes | None]) -> np.ndarray:
    """Which keys the shards' filters may hold."""
    held = np.zeros(len(first), bool)
    shard = shard_of(first, len(filters))
    for number, data in enumerate(filters):
        at = np.flatnonzero(shard == number)
        if len(at) and data is not None:
            held[at] = CuckooFilter.view(data).contains(second[at])
    return held


def references(docs: DataFrame, least: int, screen=None) -> DataFrame:
    """(k1, k2, doc_id) for each long line's key, once per row of ``docs``. Rows
    without doc_id hold nothing. ``screen`` is a broadcast of shard filters: keys
    that they surely don't hold are left out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, digests = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            if doc is None:
                continue
            found = {line_key(line, least) for line in (text.as_py() or b"").split(b"\n") if len(line) >= least}
            found.discard(None)
            digests.extend(found)
            ids.extend([doc] * len(found))
        first, second = _halves(digests)
        ids = np.array(ids, np.int64)
        if screen is not None and len(ids):
            held = _maybe_held(first, second, screen.value)
            first, second, ids = first[held], second[held], ids[held]
        return pa.RecordBatch.from_arrays(
            [pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(ids)], ["k1", "k2", "doc_id"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, f"{_KEY}, doc_id long", "text")


def shard_of(first: np.ndarray, shards: int) -> np.ndarray:
    return (first % np.uint64(shards)).astype(np.int64)


def _with_shard(keys: DataFrame, shards: int) -> DataFrame:
    """The same shard in Spark: an unsigned remainder."""
    half = F.shiftrightunsigned("k1", 1) % shards
    return keys.withColumn("shard", ((half * 2 + (F.col("k1").bitwiseAND(1))) % shards).cast("int"))


def reference_counts(held: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, last_doc) from signed references (k1, k2, doc_id, sign).
    A document counts once while its signs add up to more than nothing. A key
    that a third of all documents hold is summed in parts first."""
    alive = held.groupBy("k1", "k2", "doc_id").agg(F.sum("sign").alias("sign")).where("sign > 0")
    return alive.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, data): a cuckoo filter of the distinct ``keys`` of each shard."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of(part["k2"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "data": [made.to_bytes()]})

    return _with_shard(keys, shards).groupBy("shard").applyInPandas(build, "shard int, data binary")


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, shards: int) -> DataFrame:
    """The shard filters after ``added`` and ``removed`` keys. A shard without
    room comes back with null data, and must be built again."""
    changes = _with_shard(added, shards).withColumn("sign", F.lit(1)).unionByName(
        _with_shard(removed, shards).withColumn("sign", F.lit(-1)))

    def update(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else new)["shard"].iloc[0])
        data = old["data"].iloc[0] if len(old) else None
        if len(old) and data is None:
            return pd.DataFrame({"shard": [shard], "data": [None]})
        more, less = (new.loc[new["sign"] == s, "k2"].to_numpy(np.int64).view(np.uint64) for s in (1, -1))
        held = CuckooFilter.from_bytes(data) if data else CuckooFilter.sized(len(more))
        held.delete(less)
        room = held.insert(more)
        return pd.DataFrame({"shard": [shard], "data": [held.to_bytes() if room else None]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(update, "shard int, data binary")


def screened_by_shard(found: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The references ``found`` whose key its shard's filter may hold. Each shard's
    references go to the tasks that have its filter, one for every SHARD_ROWS of them."""
    placed = cut_lineage(_with_shard(found, shards))
    sizes = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("salts"))
    # A row for each shard.
    salted = placed.join(F.broadcast(sizes), "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "k2"), F.col("salts")).cast("int"))
    copied = filters.join(F.broadcast(sizes), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    nothing = F.lit(None)
    rows = copied.select("shard", "salt", F.lit(0).alias("kind"), nothing.cast("long").alias("k1"), nothing.cast("long").alias("k2"),
                         nothing.cast("long").alias("doc_id"), "data").unionByName(
        salted.select("shard", "salt", F.lit(1).alias("kind"), "k1", "k2", "doc_id", nothing.cast("binary").alias("data")))

    def run(batches):
        shard, held = None, None
        for batch in batches:
            marks = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if start == end:
                    continue
                part, mark = batch.slice(start, end - start), tuple(marks[start].tolist())
                if mark[:2] != shard:
                    shard, held = mark[:2], None
                if mark[2] == 0:
                    data = part.column(6)[0].as_py()
                    held = CuckooFilter.from_bytes(data) if data is not None else None
                elif held is not None:
                    maybe = pa.array(held.contains(part.column(4).to_numpy().view(np.uint64)))
                    yield pa.RecordBatch.from_arrays([part.column(i).filter(maybe) for i in (3, 4, 5)], ["k1", "k2", "doc_id"])

    return rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(run, f"{_KEY}, doc_id long")


@dataclass
class LineStore:
    """The state of incremental line dedup below one folder.

    ``references/batch=<id>`` holds the signed references of each batch, so that a
    batch that runs again replaces itself; ``filters-<id>`` holds the shard filters
    of the keys that at least ``min_docs`` documents hold, and ``state`` a row for each
    commit, so that the store can be opened again. Deleting documents appends what
    they held with the sign reversed, which restores counts, last documents and
    filters to what they would be without those documents.
    """

    spark: SparkSession
    path: str
    min_chars: int = 40
    min_docs: int = 5
    shards: int | None = None
    version: str | None = None
    commits: int = 0

    def __post_init__(self) -> None:
        if path_exists(self.spark, f"{self.path}/state"):
            last = self.spark.read.schema(_STATE).parquet(f"{self.path}/state").orderBy(F.desc("number")).first()
            if last is not None:
                self.version, self.shards, self.commits = last["version"], last["shards"], last["number"]

    def _batch(self, batch: str) -> str:
        return f"{self.path}/references/batch={batch}"

    def held(self) -> DataFrame:
        return self.spark.read.schema(f"{_KEY}, doc_id long, sign int").parquet(f"{self.path}/references")

    def frequent(self) -> DataFrame:
        return reference_counts(self.held()).where(F.col("n_docs") >= self.min_docs)

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, data binary").parquet(f"{self.path}/filters-{self.version}")

    def insert(self, docs: DataFrame, batch: str) -> None:
        found = references(docs, self.min_chars).withColumn("sign", F.lit(1))
        self._commit(found, batch)

    def delete(self, ids: DataFrame, batch: str) -> None:
        """Take the documents ``ids`` (doc_id) out again."""
        alive = self.held().groupBy("k1", "k2", "doc_id").agg(F.sum("sign").alias("sign")).where("sign > 0")
        self._commit(alive.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
                     .select("k1", "k2", "doc_id", (-F.col("sign")).cast("int").alias("sign")), batch)

    def _commit(self, found: DataFrame, batch: str) -> None:
        before = cut_lineage(self.frequent().select("k1", "k2")) if self.version else None
        found.write.mode("overwrite").parquet(self._batch(batch))
        after = cut_lineage(self.frequent().select("k1", "k2"))
        wanted = max(1, -(-after.count() // SHARD_KEYS))
        made = None
        # More keys than the shards are laid out for are dealt to new ones.
        if self.version and wanted <= self.shards:
            made = cut_lineage(update_filters(
                self.filters(), after.join(before, ["k1", "k2"], "left_anti"),
                before.join(after, ["k1", "k2"], "left_anti"), self.shards))
            if not made.where("data is null").isEmpty():
                made = None
        if made is None:
            self.shards = wanted
            made = build_filters(after, self.shards)
        # A folder of its own for each commit, as the filters may be made of those of the last one.
        self.commits += 1
        self.version = f"{batch}-{self.commits}"
        made.write.mode("overwrite").parquet(f"{self.path}/filters-{self.version}")
        self.spark.createDataFrame([(self.commits, self.version, self.shards)], _STATE).coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def _filter_bytes(self) -> int:
        return self.filters().agg(F.sum(F.length("data"))).first()[0] or 0

    def _screen(self) -> list[bytes | None]:
        tables = {r["shard"]: bytes(r["data"]) for r in self.filters().collect()}
        return [tables.get(i) for i in range(self.shards)]

    def dropped(self, docs: DataFrame) -> DataFrame:
        """(doc_id, gone): the keys whose lines each document loses. The filters
        pick candidates, the exact counts decide. Filters beyond BROADCAST_BYTES are
        not broadcast: then the keys go to their shards."""
        return self._dropped(docs, cut_lineage(self.frequent()))

    def _dropped(self, docs: DataFrame, frequent: DataFrame) -> DataFrame:
        if self._filter_bytes() <= BROADCAST_BYTES:
            candidates = references(docs, self.min_chars, self.spark.sparkContext.broadcast(self._screen()))
        else:
            candidates = screened_by_shard(references(docs, self.min_chars), self.filters(), self.shards)
        lost = lookup_join(candidates, frequent.select("k1", "k2", "last_doc"), ["k1", "k2"]).where("doc_id <> last_doc")
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("gone"))

    def cleaned(self, docs: DataFrame, lines: str = "n_lines", lost: str = "n_dropped") -> DataFrame:
        """``docs`` without the lines of :meth:`dropped`, and two counts. Up to
        EXACT_KEYS frequent keys meet the lines where the texts are, so that no text is
        shuffled; more of them are joined."""
        frequent = cut_lineage(self.frequent())
        if self._filter_bytes() > BROADCAST_BYTES or frequent.count() > EXACT_KEYS:
            return without_lines(docs, self._dropped(docs, frequent), self.min_chars, lines, lost)
        found = frequent.select("k1", "k2", "last_doc").toArrow()
        keys = _digests(*(found.column(i).to_numpy() for i in (0, 1)))
        order = np.argsort(keys)
        exact = self.spark.sparkContext.broadcast((keys[order], found.column(2).to_numpy()[order], self._screen()))
        return without_frequent_lines(docs, exact, self.min_chars, lines, lost)


def _digests(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The 16 bytes of each key."""
    return np.ascontiguousarray(np.column_stack([first, second])).view("S16")[:, 0]


def without_frequent_lines(docs: DataFrame, exact, least: int, lines: str, lost: str) -> DataFrame:
    """:func:`without_lines` for a broadcast of the sorted frequent keys, their last
    documents and the shards' filters: the filters screen, the exact keys decide."""
    docs = docs.drop(lines, lost)
    place, names = docs.columns.index("text"), [*docs.columns, lines, lost]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, last, filters = exact.value
        ids = batch.column(batch.num_columns - 1).to_pylist()
        split = [(text.as_py() or b"").split(b"\n") for text in batch.column(place).cast(pa.binary())]
        owner, at, digests = [], [], []
        for row, (doc, found) in enumerate(zip(ids, split)):
            for number, line in enumerate(found) if doc is not None else ():
                digest = line_key(line, least) if len(line) >= least else None
                if digest is not None:
                    owner.append(row)
                    at.append(number)
                    digests.append(digest)
        gone: dict[int, set[int]] = {}
        if digests and len(keys):
            maybe = np.flatnonzero(_maybe_held(*_halves(digests), filters))
            wanted = np.frombuffer(b"".join(digests), "S16")[maybe]
            near = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            for i, doc in zip(maybe[keys[near] == wanted].tolist(), last[near[keys[near] == wanted]].tolist()):
                if ids[owner[i]] != doc:
                    gone.setdefault(owner[i], set()).add(at[i])
        kept = [b"\n".join([x for n, x in enumerate(found) if n not in gone[row]] if row in gone else found) for row, found in enumerate(split)]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns[place] = pa.array(kept, pa.binary()).cast(pa.string())
        counts = [[len(x) for x in split], [len(gone.get(row, ())) for row in range(len(split))]]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in counts)], names)

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    both = docs.withColumn("text", F.col("text").cast("string")).withColumn(free_name(docs, "_line_doc"), F.col("doc_id").cast("long"))
    return per_batch(both, run, f"{schema}, {lines} long, {lost} long", "text")


def without_lines(docs: DataFrame, dropped: DataFrame, least: int, lines: str = "n_lines", lost: str = "n_dropped") -> DataFrame:
    """``docs`` with the lines of their ``gone`` keys taken out of text, and two
    counts, which replace columns of their names. A list is never longer than its
    document has lines."""
    docs = docs.drop(lines, lost)
    name, held = free_name(docs, "_gone_id"), free_name(docs, "_gone_keys")
    gone = dropped.select(F.col("doc_id").alias(name), F.col("gone").alias(held))
    both = docs.join(gone, F.col("doc_id") == F.col(name), "left").drop(name)
    place, names = docs.columns.index("text"), [*docs.columns, lines, lost]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(batch.num_columns - 1).to_pylist()
        texts, total, out = batch.column(place).cast(pa.binary()), [], []
        kept = []
        for text, gone_keys in zip(texts, keys):
            split = (text.as_py() or b"").split(b"\n")
            total.append(len(split))
            if gone_keys:
                drop = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in gone_keys}
                split = [x for x in split if len(x) < least or line_key(x, least) not in drop]
            out.append(total[-1] - len(split))
            kept.append(b"\n".join(split))
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns[place] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(out, pa.int64())], names)

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    return per_batch(both, run, f"{schema}, {lines} long, {lost} long", "text")


def deduplicated(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, lines: str = "n_lines", lost: str = "n_dropped"
) -> DataFrame:
    """``docs`` after line dedup within itself, with the counts ``lines`` and ``lost``.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents
    keeps its lines in the document with the largest doc_id only. A null text is
    one empty line. Rows that repeat a doc_id are one document; a row without
    doc_id is not counted and keeps its lines.
    """
    spark = docs.sparkSession
    store = LineStore(spark, new_folder(spark, "lines"), min_chars, min_docs)
    store.insert(docs, "0")
    return store.cleaned(docs, lines, lost)
