"""SentencePiece BPE encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsweave.llm.common import pieces

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_SLICE_BYTES = 1 << 20
# Distinct chunks whose ids a task keeps, and symbols from which a chunk is merged on its own.
_KEPT_CHUNKS = 200_000
_LONG = 48
_DEPTH = 16


@dataclass
class Vocabulary:
    """The ordinary pieces with their ids and scores, and what falls back to bytes."""

    pieces: list[str]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: list[int]
    unknown: int
    texts: list[bytes | None]

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        count = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(count)]
        names = [model.id_to_piece(i) for i in range(count)]
        ids = [i for i in range(count) if not special[i]]
        if any(len(names[i]) > _DEPTH or "\n" in names[i] or re.search(f"[^{MARK}]{MARK}", names[i]) for i in ids):
            raise ValueError("a piece is longer than 16 characters, or goes on past a word")
        byte_ids = {int(names[i][3:5], 16): i for i in range(count) if model.is_byte(i)}
        texts: list[bytes | None] = [None if s else n.replace(MARK, " ").encode() for n, s in zip(names, special)]
        for value, i in byte_ids.items():
            texts[i] = bytes([value])
        return cls([names[i] for i in ids], np.array(ids), np.array([model.get_score(i) for i in ids]),
                   [byte_ids.get(v, model.unk_id()) for v in range(256)], model.unk_id(), texts)


def _packed(codes: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """The next 16 letter numbers from each start in as few words as hold them, most
    significant first."""
    each = 64 // bits
    found = np.zeros((len(starts), -(-_DEPTH // each)), np.uint64)
    for i in range(_DEPTH):
        found[:, i // each] |= codes[starts + i].astype(np.uint64) << np.uint64(bits * (each - 1 - i % each))
    return found


def suffix_array(codes: np.ndarray, starts: np.ndarray, bits: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their next 16 letters, which is as far as a
    piece reaches, and those letters. After the first word only ties are sorted on."""
    keys = _packed(codes, starts, bits)
    order = np.argsort(keys[:, 0])
    tied = np.ones(len(order), bool)
    for column in range(1, keys.shape[1]):
        held = keys[order, column - 1]
        same = (held[1:] == held[:-1]) & (tied[1:] & tied[:-1] if column == 1 else joined)
        joined = same
        tied = np.append(same, False) | np.insert(same, 0, False)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(np.insert(~same, 0, True)[: len(order)])[at]
        order[at] = order[at][np.lexsort((keys[order[at], column], group))]
    return starts[order], keys[order]


def _bound(keys: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every wanted row among sorted rows."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = np.minimum((low + high) // 2, max(len(keys) - 1, 0))
        before, equal = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for column in range(keys.shape[1]):
            held = keys[middle, column]
            before |= equal & (held < wanted[:, column])
            equal &= held == wanted[:, column]
        if right:
            before |= equal
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)


class Matcher:
    """The vocabulary laid out for searching."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        letters = sorted(set("".join(vocabulary.pieces)))
        if len(letters) >= 65_535:
            raise ValueError("too many different letters")
        # 0 stands between chunks and for letters of no piece.
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.lengths = np.array([len(p) for p in vocabulary.pieces])
        self.flat = self.numbers("".join(p.ljust(_DEPTH, "\0") for p in vocabulary.pieces)).reshape(-1, _DEPTH)

    def numbers(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, 0).astype(np.int32)

    def edges(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces occur: sorted start * 32 + length, and the piece's number."""
        start, piece = self.occurrences(codes, starts)
        at = start * 32 + self.lengths[piece]
        order = np.argsort(at)
        return at[order], piece[order].astype(np.int32)

    def occurrences(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts at which pieces occur, and the pieces' numbers, in their order."""
        # Letters are numbered anew among those of the text, so that more of them fit a
        # word; pieces with other letters have no edges.
        used = np.union1d([0], codes)
        bits = 8 if len(used) < 256 else 16
        known = np.zeros(len(self.letters) + 1, np.int32)
        known[used] = np.arange(len(used))
        own = known[self.flat]
        there = ((own > 0) | (self.flat == 0)).all(axis=1)
        wanted = np.flatnonzero(there)
        own = own[wanted].astype(np.uint64)
        begins = np.arange(len(wanted)) * _DEPTH
        least = _packed(own.reshape(-1), begins, bits)
        most = _packed(np.where(own == 0, (1 << bits) - 1, own).reshape(-1), begins, bits)
        places, keys = suffix_array(known[codes], starts, bits)
        low, high = _bound(keys, least, False), _bound(keys, most, True)
        counts = np.zeros(len(self.lengths), np.int64)
        counts[wanted] = high - low
        first = np.zeros(len(self.lengths), np.int64)
        first[wanted] = low
        piece = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        return places[np.repeat(first, counts) + within], piece

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after another, and how many each has."""
        scores, ids = self.vocabulary.scores, self.vocabulary.ids
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        text = "\0".join(chunks) + "\0" * (_DEPTH + 1)
        codes = self.numbers(text)
        begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(chunks) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(chunks)), sizes)
        starts = np.arange(len(owner)) + owner
        # The piece of each start and length, or -1.
        edges = np.full(len(codes) * _DEPTH, -1, np.int32)
        start, piece = self.occurrences(codes, starts)
        edges[start * _DEPTH + self.lengths[piece] - 1] = piece

        def piece_of(start: np.ndarray, length: np.ndarray) -> np.ndarray:
            return np.where(length <= _DEPTH, edges[start * _DEPTH + np.minimum(length, _DEPTH) - 1], -1)

        # Relaxing: the best-scored edge over two neighbouring symbols is taken, the
        # leftmost of equals, until a chunk has none left. This is BPE's order.
        long = sizes > _LONG
        spans: dict[int, np.ndarray] = {}
        for number in np.flatnonzero(long).tolist():
            spans[number] = self._merged_alone(int(begins[number]), int(sizes[number]), piece_of)
        live = ~long[owner]
        start, chunk = starts[live], owner[live]
        limits = begins + sizes
        done_start, done_chunk = [], []

        def value_of(start: np.ndarray, chunk: np.ndarray, pair: np.ndarray) -> np.ndarray:
            # What merging the symbol at each place with the next one scores.
            after = np.append(start[2:], [0, 0])[pair]
            chunk_after = np.append(chunk[2:], [-1, -1])[pair]
            end = np.where(chunk_after == chunk[pair], after, limits[chunk[pair]])
            inside = np.append(chunk[1:], -1)[pair] == chunk[pair]
            found = piece_of(start[pair], end - start[pair])
            return np.where(inside & (found >= 0), scores[found], -np.inf)

        value = value_of(start, chunk, np.arange(len(start)))
        while len(start):
            heads = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            best = np.maximum.reduceat(value, heads)
            lengths = np.diff(np.append(heads, len(start)))
            ended = np.repeat(~np.isfinite(best), lengths)
            if ended.any():
                done_start.append(start[ended])
                done_chunk.append(chunk[ended])
                start, chunk, value = start[~ended], chunk[~ended], value[~ended]
                best, lengths = best[np.isfinite(best)], lengths[np.isfinite(best)]
                if not len(start):
                    break
            # The leftmost of the best in each chunk.
            at = np.flatnonzero(value == np.repeat(best, lengths))
            chosen = at[np.append(True, chunk[at][1:] != chunk[at][:-1])]
            keep = np.ones(len(start), bool)
            keep[chosen + 1] = False
            start, chunk, value = start[keep], chunk[keep], value[keep]
            # A merge takes one symbol out of each chunk, and changes its own pair and the one before.
            merged = chosen - np.arange(len(chosen))
            before = merged[(merged > 0) & (chunk[merged - 1] == chunk[merged])] - 1
            changed = np.concatenate([merged, before])
            value[changed] = value_of(start, chunk, changed)
        for number, at in spans.items():
            done_start.append(at)
            done_chunk.append(np.full(len(at), number))
        start = np.concatenate(done_start) if done_start else np.zeros(0, np.int64)
        chunk = np.concatenate(done_chunk) if done_chunk else np.zeros(0, np.int64)
        order = np.argsort(start, kind="stable")
        start, chunk = start[order], chunk[order]
        ends = np.append(start[1:], 0)
        last = np.append(chunk[1:] != chunk[:-1], True) if len(chunk) else np.zeros(0, bool)
        ends[last] = (begins + sizes)[chunk[last]]
        piece = piece_of(start, ends - start)
        width = np.ones(len(start), np.int64)
        fallback = [[self.vocabulary.byte_ids[b] for b in text[s:e].encode("utf-8", "surrogatepass")]
                    for s, e in zip(start[piece < 0].tolist(), ends[piece < 0].tolist())]
        width[piece < 0] = [len(f) for f in fallback]
        out = np.repeat(np.where(piece >= 0, ids[piece], 0), width)
        out[np.repeat(piece < 0, width)] = [i for f in fallback for i in f]
        return out.astype(np.int32), np.bincount(chunk, width, len(chunks)).astype(np.int64)

    def _merged_alone(self, begin: int, size: int, piece_of) -> np.ndarray:
        """Symbol starts of one long chunk, by a queue of neighbouring pairs."""
        scores = self.vocabulary.scores
        widths = np.arange(1, _DEPTH + 1)
        grid = piece_of(np.repeat(np.arange(begin, begin + size), _DEPTH), np.tile(widths, size)).reshape(size, _DEPTH)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        length = [1] * size
        queue: list[tuple[float, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < size:
                both = length[left] + length[right]
                if both <= _DEPTH and left + both <= size and grid[left, both - 1] >= 0:
                    heapq.heappush(queue, (-scores[grid[left, both - 1]], left, length[left], length[right]))

        for left in range(size - 1):
            offer(left)
        while queue:
            _, left, own, other = heapq.heappop(queue)
            right = left + own
            if length[left] != own or right >= size or after[left] != right or length[right] != other:
                continue
            length[left] += other
            length[right] = 0
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return np.array([begin + i for i in range(size) if length[i]], np.int64)


class _Numbers(dict):
    """Chunks numbered in the order in which they are first asked for."""

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        return number


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver and sent along with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def chunks_of(text: str) -> list[str]:
    """The text with the mark for blanks and before its start, cut where no piece
    crosses; nothing for an empty text."""
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def _ranges(firsts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The ``widths`` numbers from each of ``firsts``, one range after another."""
    return np.arange(widths.sum()) + np.repeat(firsts - (np.cumsum(widths) - widths), widths)


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with ``piece_ids`` (array of int; a column of that name is replaced),
    the ids of each whole text in the BPE model given by its file's bytes.

    The ids are those of the model's own library for models that keep the text as
    it is, put a blank first and fall back to bytes; other models are refused or
    differ. Null and empty texts have no ids. A task concatenates the distinct
    chunks of its texts, sorts the suffixes, searches all pieces in them and merges
    along the edges found.
    """
    docs = docs.drop("piece_ids")
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.parse(model))
    place, names = docs.columns.index("text"), [*docs.columns, "piece_ids"]

    def run(batches):
        matcher = Matcher(shared.value)
        numbers = _Numbers()
        # Ids of the chunks one after another, where those of each end, and how often each was met.
        flat, ends, uses = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in pieces(batch, "text", _SLICE_BYTES) if batch.num_rows else ():
                if len(numbers) > _KEPT_CHUNKS:
                    # The chunks that were met most often stay.
                    kept = np.argsort(-uses, kind="stable")[: _KEPT_CHUNKS // 2]
                    kept = np.sort(kept[uses[kept] > 1])
                    names_met, widths = list(numbers), np.diff(ends, prepend=0)[kept]
                    numbers = _Numbers((names_met[i], n) for n, i in enumerate(kept.tolist()))
                    flat, ends, uses = flat[_ranges(ends[kept] - widths, widths)], np.cumsum(widths), uses[kept] // 2
                known, rows = len(numbers), []
                for text in part.column(place):
                    own = chunks_of(text.as_py() or "")
                    rows.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
                ids, counts = matcher.encode(list(islice(reversed(numbers), len(numbers) - known))[::-1])
                flat, ends = np.concatenate([flat, ids]), np.concatenate([ends, len(flat) + np.cumsum(counts)])
                used = np.concatenate(rows)
                uses = np.append(uses, np.zeros(len(counts), np.int64)) + np.bincount(used, minlength=len(ends))
                widths = np.diff(ends, prepend=0)[used]
                values = flat[_ranges(ends[used] - widths, widths)]
                per_row = np.concatenate(([0], np.cumsum(widths)))[np.cumsum([0, *map(len, rows)])]
                lists = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, piece_ids array<int>")


def decode(encoded: DataFrame, model: bytes, out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``piece_ids`` in ``out``; null ids give null.
    Bytes that are no UTF-8 become U+FFFD, control ids nothing."""
    encoded = encoded.drop(out)
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.parse(model).texts)
    place, names = encoded.columns.index("piece_ids"), [*encoded.columns, out]

    def run(batches):
        texts = pa.array([t or b"" for t in shared.value], pa.large_binary())
        for batch in batches:
            found = []
            for ids in batch.column(place):
                if not ids.is_valid:
                    found.append(None)
                    continue
                # The pieces of a row lie one after another in one buffer.
                own = texts.take(ids.values)
                ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
                data = own.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if len(own) else b""
                found.append(data.removeprefix(b" ").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, `{out}` string")
