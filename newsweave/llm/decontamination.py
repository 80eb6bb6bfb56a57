"""Benchmark decontamination with spaced seeds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsweave.llm.common import free_name, pieces
from newsweave.session import cut_lineage

# The word places that each mask compares; the others are ignored.
# The first alone meets every window of 13 words with up to two substitutions; the
# second finds many of them again.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 2, 3, 5))
WINDOW = 13
SIMILARITY = 0.8
# Items of fewer words are everyday phrases and overlap nothing.
MIN_WORDS = 6
# Benchmark words whose seeds a task holds at once.
BLOCK_WORDS = 500_000
_WORD = re.compile(r"[^\W_]+")
_SLICE_BYTES = 4 << 20
_BITS = 22
_OUT = "doc_id long, item int, doc_start long, doc_end long, matched long, compared long"


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall(text.lower())


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def seeds(ids: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the places where all masked words are known (not 0)."""
    room = len(ids) - mask[-1]
    if room <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = np.ones(room, bool)
    for place in mask:
        known &= ids[place : place + room] > 0
    starts = np.flatnonzero(known)
    hashes = np.zeros(len(starts), np.uint64)
    for place in mask:
        hashes = _mixed(hashes + ids[starts + place].astype(np.uint64))
    return starts, hashes


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of which one meets an item of ``n`` words whichever words are substituted,
    if 0.8 of them are left: with s substitutions, every (s + 1)-th word from each of
    the first s + 1 on."""
    step = n - -(-n * 8 // 10) + 1
    return [tuple(range(first, n, step)) for first in range(step)]


@dataclass
class Block:
    """Some benchmark items: their words by number (from 1; 0 stands between
    items), the words' numbers, and for each mask the sorted seeds."""

    vocabulary: dict[str, int]
    ids: np.ndarray
    item: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    masks: list
    tables: list

    @classmethod
    def of(cls, items: list[tuple[int, list[str]]]) -> Block:
        vocabulary: dict[str, int] = {}
        lengths = np.array([len(w) for _, w in items], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if items else np.zeros(0, np.int64)
        ids = np.zeros(int((lengths + 1).sum()), np.int64)
        item = np.full(len(ids), -1, np.int64)
        for number, (start, (_, words)) in enumerate(zip(starts.tolist(), items)):
            ids[start : start + len(words)] = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            item[start : start + len(words)] = number
        # Items shorter than a window are compared as wholes, with masks of their own from their first word.
        short = sorted({n for n in lengths.tolist() if MIN_WORDS <= n < WINDOW})
        sized = [*((mask, 0) for mask in MASKS), *((mask, n) for n in short for mask in short_masks(n))]
        masks, tables = [mask for mask, _ in sized], []
        for mask, n in sized:
            at, hashes = seeds(ids, mask)
            # A mask may begin on the word before an item's first one, which is none.
            own = item[at]
            size = np.where(own >= 0, lengths[own], 0)
            use = size >= WINDOW if not n else (size == n) & (at == starts[own])
            at, hashes = at[use], hashes[use]
            order = np.argsort(hashes, kind="stable")
            at, hashes = at[order], hashes[order]
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[hashes & np.uint64((1 << _BITS) - 1)] = True
            tables.append((hashes, at, bitmap))
        return cls(vocabulary, ids, item, starts, lengths, masks, tables)

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (diagonal, item): words of ``ids`` less words of the block."""
        found = []
        for mask, (hashes, at, bitmap) in zip(self.masks, self.tables):
            places, own = seeds(ids, mask)
            maybe = bitmap[own & np.uint64((1 << _BITS) - 1)]
            places, own = places[maybe], own[maybe]
            low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            counts = high - low
            # In steps, so that a phrase in many items doesn't fill the memory.
            for part in np.array_split(np.arange(len(own)), int(counts.sum()) // 1_000_000 + 1):
                n = counts[part]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                other = at[np.repeat(low[part], n) + within]
                found.append(np.unique(np.stack([np.repeat(places[part], n) - other, self.item[other]], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def overlap(self, ids: np.ndarray, start: int, end: int, diagonal: int, number: int) -> tuple | None:
        """The verified overlap of words ``start:end`` with an item along one
        diagonal: first and last place, equal words and compared words."""
        own = int(self.starts[number])
        size = int(self.lengths[number])
        low, high = max(start, own + diagonal), min(end, own + size + diagonal)
        window = min(WINDOW, size)
        if high - low < window:
            return None
        equal = ids[low:high] == self.ids[low - diagonal : high - diagonal]
        sums = np.concatenate(([0], np.cumsum(equal)))
        need = -(-window * 8 // 10)
        good = np.flatnonzero(sums[window:] - sums[:-window] >= need)
        if not len(good):
            return None
        first, last = int(good[0]), int(good[-1]) + window
        inner = np.flatnonzero(equal[first:last])
        first, last = first + int(inner[0]), first + int(inner[-1]) + 1
        return low + first - start, low + last - start, int(sums[last] - sums[first]), last - first


def _searched(docs: DataFrame, block: Block) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", _SLICE_BYTES) if batch.num_rows else ():
                held: Block = shared.value
                ids, bounds = [np.zeros(1, np.int64)], []
                at = 1
                for text in part.column(1):
                    words = words_of(text.as_py() or "")
                    ids.append(np.fromiter(map(held.vocabulary.get, words, repeat(0)), np.int64, len(words)))
                    ids.append(np.zeros(1, np.int64))
                    bounds.append((at, at + len(words)))
                    at += len(words) + 1
                flat = np.concatenate(ids)
                begins = np.array([b for b, _ in bounds], np.int64)
                rows = []
                for diagonal, number in held.hits(flat).tolist():
                    # An item's words never reach into another document: 0 equals nothing known.
                    own = int(held.starts[number]) + diagonal
                    for doc in range(max(0, int(np.searchsorted(begins, own, "right")) - 1), len(bounds)):
                        if bounds[doc][0] >= own + int(held.lengths[number]):
                            break
                        found = held.overlap(flat, *bounds[doc], diagonal, number)
                        if found:
                            rows.append((part.column(0)[doc].as_py(), number, *found))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*rows))],
                        [c.split()[0] for c in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_start, doc_end, matched, compared): passages of ``docs``
    (doc_id, text) that overlap a benchmark item (item_id, text).

    Both are lower-case words of letters and digits. A seed hit fixes a diagonal.
    Along it, every 13 words in a row with at least 0.8 of them equal count, and the
    overlap reaches from the first to the last equal word of such windows; of an item
    of fewer words 0.8 must be equal, one below MIN_WORDS overlaps nothing. Places are words of the document, end
    exclusive. Items with the same words give a row each; one with no words, and
    null texts, overlap nothing. Rows that repeat give repeated rows, null ids stay.
    The benchmark is searched in blocks of BLOCK_WORDS words, whose seeds a task
    can hold, so a larger benchmark means more passes and never fewer items.
    """
    split = F.expr("filter(split(lower(coalesce(text, '')), '[^\\\\p{L}\\\\p{N}]+'), x -> x <> '')")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.withColumn("body", F.concat_ws(" ", split)).where("body <> ''")
    items = cut_lineage(items)
    bodies = items.groupBy("body").agg(F.size(F.split("body", " ")).alias("n"))
    total = bodies.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    numbered = bodies.withColumn("block", F.pmod(F.xxhash64("body"), F.lit(max(1, blocks))))
    found = None
    for number in range(blocks):
        held = [r["body"] for r in numbered.where(F.col("block") == number).select("body").orderBy("body").toLocalIterator()]
        block = Block.of([(i, words_of(b)) for i, b in enumerate(held)])
        names = docs.sparkSession.createDataFrame([(i, b) for i, b in enumerate(held)], "item int, body string")
        part = _searched(docs, block).join(F.broadcast(names), "item").drop("item")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, doc_start long, doc_end long, matched long, compared long")
    return found.join(items.select("item_id", "body"), "body").select(
        "doc_id", "item_id", "doc_start", "doc_end", "matched", "compared")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item. Rows that repeat a
    doc_id go if any of them does; a row without doc_id stays."""
    name = free_name(docs, "_gone_id")
    gone = overlaps(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
