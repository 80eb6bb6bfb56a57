"""Spelling variants grouped through Bloom-guided edit neighbourhoods."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from newsweave.llm.common import pieces
from newsweave.operators.joins import lookup_join
from newsweave.session import cut_lineage

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
# A word's run is damaged if this number divides the checksum of where it stands.
DAMAGE = 97
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Letters of a lower-cased run.
_ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
# Distinct words that a task counts before it passes them on.
HELD_WORDS = 300_000
SLICE_BYTES = 8 << 20
# Filters: bits a word, bits set, words of 64 bits in a block, words of one shard, and
# bytes of filters that are broadcast at once. Lengths from LAST_LENGTH on share their shards.
BITS, MARKS, BLOCK = 16, 6, 8
SHARD_WORDS = 1 << 20
FILTER_BYTES = 64 << 20
LAST_LENGTH = 32
# Edits whose hashes a task holds at a time.
PROBES = 1 << 20


def runs(text: str) -> list[str]:
    return [w.translate(_LOWER) for w in _RUN.findall(text)]


def damaged(name: bytes, run: str) -> str:
    """``run`` as it is counted in the document whose id and colon are ``name``."""
    checksum = zlib.crc32(name + run.encode())
    if checksum % DAMAGE:
        return run
    place = checksum % len(run)
    return run[:place] + run[place + 1 :]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): words of MIN_LENGTH code points or more that
    occur MIN_COUNT times or more. Words are counted in each task first, so a frequent
    word costs a row a task. A null doc_id is an empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in pieces(batch, "text", SLICE_BYTES) if batch.num_rows else ():
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    name = b":" if doc is None else f"{doc}:".encode()
                    for run, often in Counter(runs(text.as_py() or "")).items():
                        word = damaged(name, run)
                        if len(word) >= MIN_LENGTH:
                            held[word] += often
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letter_hash(place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of a letter at a place; a word's hash is all of its letters' xored, so
    that of an edit follows from it."""
    return _mixed(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + code.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _codes(words: list[str]) -> np.ndarray:
    """(word, place) code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def word_hashes(words: list[str]) -> np.ndarray:
    """The hash of each word."""
    found = np.zeros(len(words), np.uint64)
    for length in {len(w) for w in words}:
        at = [i for i, w in enumerate(words) if len(w) == length]
        codes = _codes([words[i] for i in at])
        found[at] = np.bitwise_xor.reduce(_letter_hash(np.arange(length)[None, :], codes), axis=1)
    return found


def _shard_length(length: int) -> int:
    return min(length, LAST_LENGTH)


class Filters:
    """Blocked Bloom filters by word length, each cut into equal shards by hash. Those
    that aren't held say no to everything."""

    def __init__(self, shards: dict[int, int], held: dict[tuple[int, int], np.ndarray]):
        self.shards, self.held = shards, held

    def maybe(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be words of that length."""
        length = _shard_length(length)
        count = self.shards.get(length, 0)
        found = np.zeros(len(hashes), bool)
        for shard in range(count):
            words = self.held.get((length, shard))
            if words is None:
                continue
            at = np.arange(len(hashes)) if count == 1 else np.flatnonzero(shard_of(hashes, count) == shard)
            if len(at):
                found[at] = holds(words, hashes[at])
        return found


def shard_of(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(count)).astype(np.int64)


def _spots(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and a generator of further bits for its marks."""
    block = ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    return block * BLOCK, _mixed(hashes + np.uint64(0x9E3779B97F4A7C15))


def _marks(more: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    bits = (more >> np.uint64(9 * mark)) & np.uint64(511)
    return (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63))


def filled(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """A filter of ``blocks`` blocks that holds the hashes."""
    words = np.zeros(blocks * BLOCK, np.uint64)
    first, more = _spots(hashes, blocks)
    for mark in range(MARKS):
        place, bit = _marks(more, mark)
        np.bitwise_or.at(words, first + place, bit)
    return words


def holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    first, more = _spots(hashes, len(words) // BLOCK)
    found = np.arange(len(hashes))
    for mark in range(MARKS):
        place, bit = _marks(more[found], mark)
        found = found[(words[first[found] + place] & bit) != 0]
    answer = np.zeros(len(hashes), bool)
    answer[found] = True
    return answer


def _filters(words: DataFrame) -> tuple[dict[int, int], list[tuple[int, int]], DataFrame]:
    """How many shards each length has, all shards, and the stored filters (length,
    shard, bits). A shard is filled by one task from about SHARD_WORDS words, each of
    which it sees as a hash."""
    size = F.least(F.char_length("word"), F.lit(LAST_LENGTH)).alias("length")
    # At most LAST_LENGTH rows.
    counts = {r["length"]: r["n"] for r in words.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = {length: -(-n // SHARD_WORDS) for length, n in counts.items()}
    blocks = {length: max(-(-(n // shards[length] + 1) * BITS // (64 * BLOCK)), 1) for length, n in counts.items()}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            hashes = word_hashes(names)
            lengths = np.array([_shard_length(len(w)) for w in names], np.int64)
            count = np.array([shards[x] for x in lengths.tolist()], np.uint64)
            place = ((hashes >> np.uint64(40)) % np.maximum(count, np.uint64(1))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(place), pa.array(hashes.view(np.int64))], ["length", "shard", "hash"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            length, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hashes = batch.column(2).to_numpy().view(np.uint64)
            # In the rows' order: a shard given out before its last rows came would lose those.
            for key in sorted(set(zip(length.tolist(), shard.tolist()))):
                own = hashes[(length == key[0]) & (shard == key[1])]
                if key not in held:
                    # The rows are sorted, so earlier shards are complete.
                    for done in [k for k in held if k < key]:
                        yield _filter_row(done, held.pop(done))
                    held[key] = np.zeros(blocks[key[0]] * BLOCK, np.uint64)
                held[key] |= filled(own, blocks[key[0]])
        for done, words_ in held.items():
            yield _filter_row(done, words_)

    table = words.select("word").mapInArrow(hashed, "length long, shard long, hash long")
    table = table.repartition("length", "shard").sortWithinPartitions("length", "shard").mapInArrow(fill, "length long, shard long, bits binary")
    return shards, [(length, i) for length in sorted(shards) for i in range(shards[length])], cut_lineage(table)


def _filter_row(key: tuple[int, int], words: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([words.tobytes()], pa.binary())], ["length", "shard", "bits"])


def _deletions(codes: np.ndarray, filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the deletions of one letter that may be words. Of equal
    neighbouring letters only the first is left out."""
    count, length = codes.shape
    places = np.arange(length)[None, :]
    own = _letter_hash(places, codes)
    moved = _letter_hash(places - 1, codes)
    before = np.bitwise_xor.accumulate(np.hstack([np.zeros((count, 1), np.uint64), own]), axis=1)[:, :-1]
    after = np.bitwise_xor.accumulate(np.hstack([moved, np.zeros((count, 1), np.uint64)])[:, ::-1], axis=1)[:, ::-1][:, 1:]
    different = np.ones(codes.shape, bool)
    different[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, place = np.nonzero(different)
    maybe = filters.maybe(length - 1, (before ^ after)[row, place])
    return row[maybe], place[maybe]


def _replacements(codes: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, letter) of the replacements by a later letter that may be words. A
    pair of words is found from the one whose letter comes first."""
    count, length = codes.shape
    own = _letter_hash(np.arange(length)[None, :], codes)
    whole = np.bitwise_xor.reduce(own, axis=1)
    for start in range(0, length, max(PROBES // max(count * len(_ALPHABET), 1), 1)):
        places = np.arange(start, min(start + max(PROBES // max(count * len(_ALPHABET), 1), 1), length))
        rest = whole[:, None] ^ own[:, places]
        new = _letter_hash(places[:, None], _ALPHABET[None, :])
        row, at, letter = np.nonzero(codes[:, places][:, :, None] < _ALPHABET[None, None, :])
        maybe = filters.maybe(length, rest[row, at] ^ new[at, letter])
        yield row[maybe], places[at[maybe]], letter[maybe]


def _candidates(words: DataFrame, shared: Broadcast) -> DataFrame:
    """(word, n, edit) for edits of each word that one of the ``shared`` filters lets through."""
    letters = [chr(int(c)) for c in _ALPHABET]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(*shared.value)
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in names])
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                step = max(PROBES // (length * len(_ALPHABET)), 1)
                for start in range(0, len(at), step):
                    group = at[start : start + step]
                    own = [names[i] for i in group.tolist()]
                    codes = _codes(own)
                    row, place = _deletions(codes, filters)
                    rows, edits = [row], [own[r][:p] + own[r][p + 1 :] for r, p in zip(row.tolist(), place.tolist())]
                    for row, place, letter in _replacements(codes, filters):
                        rows.append(row)
                        edits += [own[r][:p] + letters[c] + own[r][p + 1 :] for r, p, c in zip(row.tolist(), place.tolist(), letter.tolist())]
                    if edits:
                        where = group[np.concatenate(rows)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), pa.array(counts[where]), pa.array(edits, pa.string())], ["word", "n", "edit"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, edit string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, for the words of ``words`` (word, n) that differ
    by exactly one inserted, deleted or replaced code point.

    An insertion is the other word's deletion, and a replacement by an earlier letter
    the other's by a later one, so deletions and half of the replacements are probed.
    Filters are broadcast FILTER_BYTES at a time; where they take more, the words are
    probed once for each portion. Only edits that a filter lets through are shuffled,
    and an exact join with the words drops those that are none.
    """
    shards, order, stored = _filters(words)
    per_shard = SHARD_WORDS * BITS // 8
    portion = max(FILTER_BYTES // per_shard, 1)
    exact = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    pairs = words.sparkSession.createDataFrame([], "a string, an long, b string, bn long")
    for start in range(0, len(order), portion):
        part = order[start : start + portion]
        low, high = part[0], part[-1]
        rows = stored.where(
            ((F.col("length") > low[0]) | ((F.col("length") == low[0]) & (F.col("shard") >= low[1])))
            & ((F.col("length") < high[0]) | ((F.col("length") == high[0]) & (F.col("shard") <= high[1])))).toArrow().to_pylist()
        held = {(r["length"], r["shard"]): np.frombuffer(r["bits"], np.uint64) for r in rows}
        shared = words.sparkSession.sparkContext.broadcast((shards, held))
        found = _candidates(words, shared).join(exact, "edit")
        # Written once, so that the portion's filters can go; a pair then stands on both of its words.
        pairs = pairs.unionByName(cut_lineage(found.select(
            F.col("word").alias("a"), F.col("n").alias("an"), F.col("edit").alias("b"), F.col("edit_n").alias("bn"))))
        shared.unpersist()
    return pairs.selectExpr("a as word", "an as n", "b as near", "bn as near_n").unionByName(
        pairs.selectExpr("b as word", "bn as n", "a as near", "an as near_n"))


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last of the forms that follow. Each
    round doubles the steps; n at least doubles with each form, so rounds are few."""
    current = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut_lineage(lookup_join(current, onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if stepped.where("moved").isEmpty():
            return stepped.select("word", "root")
        current = stepped.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the ``vocabulary`` of ``docs``
    (doc_id, text; other columns are not looked at).

    A word's form is its near word of largest n, the smallest in code-point order of
    equals, if that n is RATIO times the word's or more; else null. root follows the
    forms to the last. Null and empty texts have no words, repeated rows count each
    time, an empty table gives no rows.
    """
    words = cut_lineage(vocabulary(docs))
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    chosen = words.join(best, "word", "left").withColumn("form_n", -F.col("best.m"))
    apt = F.col("form_n") >= RATIO * F.col("n")
    chosen = cut_lineage(chosen.select(
        "word", F.when(apt, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(apt, F.col("form_n")).alias("form_n")))
    roots = _rooted(chosen.where("form is not null").select("word", "form"))
    return chosen.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
