"""Repair of conversation structure by the cheapest edits, the least of equals by ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsweave.operators.ranking import _cut_points, _piece, row_numbers
from newsweave.session import cut_lineage

# Costs of the edits; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Conversations with more rows are cut into blocks of as many.
BLOCK_ROWS = 50_000
# Rows that a task repairs at a time.
BATCH_ROWS = 100_000
# States of `(s?(ua)+)?`: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_ACCEPTED = np.array([0, 1 << 40, 1 << 40, 0], np.int64)
_FAR = 1 << 40
_KEEP = {"s": [SYSTEM, -1, -1, -1], "u": [USER, USER, -1, USER], "a": [-1, -1, ASSISTANT, -1]}
# Where an inserted row or one of another role leads: a user, after a user an assistant.
_NEXT = [USER, USER, ASSISTANT, USER]
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
_D, _I, _K, _R = 1, 2, 3, 4
_SPACE = " \t\n\x0b\x0c\r"
_NAMES = {USER: "user", ASSISTANT: "assistant"}


def filled(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one space for a null role or text."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults planted by the checksum of
    `conv_id:turn` (a null is one space) modulo 20: 0 drops a row, 1 empties its text,
    2 takes its final marks away, 3 repeats it, 4 makes its role user."""
    rows = filled(rows)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kept = rows.withColumn("_fault", F.crc32(name) % 20).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copies")).withColumn(
        "_copy", F.explode("_copies")).select("conv_id", "turn", "role", "text")


def _states(cells: np.ndarray) -> np.ndarray:
    """The cheaper of a state's cost and that of inserting rows from it on, over the last axis."""
    best = cells.copy()
    for _ in range(2):
        best = np.minimum(best, INSERT + best[..., _NEXT])
    return best


def _row_costs(role: np.ndarray, dead: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(rows, state, letter) costs of deleting, keeping and giving another role, and
    the state that each leads to. ``role``: 0 s, 1 u, 2 a, 3 others."""
    keep = np.array([*_KEEP.values(), [-1] * 4])[role]
    extra = np.where(cut, TRUNCATED, 0)[:, None]
    costs = np.full((len(role), 4, 3), _FAR, np.int64)
    ends = np.zeros((len(role), 4, 3), np.int64)
    costs[:, :, 0], ends[:, :, 0] = DELETE, np.arange(4)
    costs[:, :, 1] = np.where((keep >= 0) & ~dead[:, None], extra, _FAR)
    ends[:, :, 1] = np.maximum(keep, 0)
    costs[:, :, 2], ends[:, :, 2] = np.where(dead[:, None], _FAR, REROLE + extra), _NEXT
    return costs, ends


def suffix_costs(first: np.ndarray, size: np.ndarray, costs: np.ndarray, ends: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Cost DP from the end of each sequence: for every row and state the least cost
    from before the row on, with ``last`` (sequence, state) after the last row. The
    sequences (rows ``first`` to ``first + size``) go side by side, step by step."""
    before = np.zeros((len(costs), 4), np.int64)
    order = np.argsort(-size, kind="stable")
    first, size, after = first[order], size[order], last[order].copy()
    most = int(size[0]) if len(size) else 0
    going = np.searchsorted(-size, -np.arange(most), side="left")
    for step in range(most):
        n = going[step]
        row = first[:n] + size[:n] - 1 - step
        reached = np.take_along_axis(after[:n, None, :], ends[row], axis=2)
        after[:n] = _states((costs[row] + reached).min(axis=2))
        before[row] = after[:n]
    return before


def least_paths(label: np.ndarray, target: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pointers of doubled lengths along the least path from every node, and the nodes' first letters.

    ``label`` and ``target`` (node, arc) are the arcs that an optimal path may take,
    label 0 where there is none; node 0 is the end. Nodes are ranked by the least
    sequence of 1, 2, 4, ... letters that starts there, an ended one first. Among
    arcs of equal letter that with the lower rank is taken, so a round's pointers hold for its length.
    """
    rank = np.where(label.max(axis=1) > 0, 1, 0)
    nodes = np.arange(len(label))
    length = 1
    while True:
        order = np.where(label > 0, label.astype(np.int64) * (rank.max() + 1) + rank[target], np.iinfo(np.int64).max)
        best = order.argmin(axis=1)
        letter = label[nodes, best]
        jumps = [np.where(letter > 0, target[nodes, best], 0)]
        rank = letter.astype(np.int64)
        while (1 << (len(jumps) - 1)) < length:
            pair = rank * (rank.max() + 1) + rank[jumps[-1]]
            rank = np.unique(pair, return_inverse=True)[1]
            jumps.append(jumps[-1][jumps[-1]])
        if length >= 2 * longest:
            return jumps, letter
        length *= 2


class Repair:
    """Cheapest edits of sequences of rows that lie one after another, with ``last``
    costs per state after each. ``closed`` sequences may insert rows at their end;
    in others that is left to the block that follows."""

    def __init__(self, size: np.ndarray, role: np.ndarray, dead: np.ndarray, cut: np.ndarray, last: np.ndarray, closed: bool):
        self.size, self.first = size, np.cumsum(size) - size
        self.costs, self.ends = _row_costs(role, dead, cut)
        self.last = _states(last) if closed else last
        self.before = suffix_costs(self.first, size, self.costs, self.ends, self.last)
        self.closed = closed

    def start_costs(self) -> np.ndarray:
        """(sequence, state) least costs from the start on."""
        found = self.last.copy()
        some = self.size > 0
        found[some] = self.before[self.first[some]]
        return found

    def paths(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The least optimal path of each sequence from its ``entry`` state: how many
        letters it has, all letters (1 to 4), the state each letter starts from, and
        the state at the end. Node 0 is the end; then come the states after each
        sequence, then those before each row."""
        count, rows = len(self.size), len(self.costs)
        after = 1 + np.arange(count)[:, None] * 4 + np.arange(4)
        node = 1 + 4 * count + np.arange(rows)[:, None] * 4 + np.arange(4)
        owner = np.repeat(np.arange(count), self.size)
        total = 1 + 4 * (count + rows)
        label, target = np.zeros((total, 4), np.int8), np.zeros((total, 4), np.int64)
        if rows:
            ended = np.arange(rows) == (self.first + self.size - 1)[owner]
            onward = np.where(ended[:, None], after[owner], np.vstack([node[1:], node[:1]]))
            later = np.where(ended[:, None], self.last[owner], np.vstack([self.before[1:], self.before[:1]]))
            for arc, letter in enumerate((_D, _K, _R)):
                reached = np.take_along_axis(later, self.ends[:, :, arc], axis=1)
                right = self.costs[:, :, arc] + reached == self.before
                label[node, arc] = np.where(right, letter, 0)
                target[node, arc] = np.where(right, np.take_along_axis(onward, self.ends[:, :, arc], axis=1), 0)
            right = self.before == INSERT + self.before[:, _NEXT]
            label[node, 3], target[node, 3] = np.where(right, _I, 0), np.where(right, node[:, _NEXT], 0)
        if self.closed:
            right = (self.last == INSERT + self.last[:, _NEXT]) & (self.last > 0)
            label[after, 3], target[after, 3] = np.where(right, _I, 0), np.where(right, after[:, _NEXT], 0)
        start = after.copy()
        some = self.size > 0
        start[some] = node[self.first[some]]
        start = start[np.arange(count), entry]
        longest = int(3 * self.size.max() + 3) if count else 1
        jumps, letter = least_paths(label, target, longest)
        # Letters left from a start node on: the doubled pointers that stay short of the end.
        length, at = np.zeros(count, np.int64), start.copy()
        for k in range(len(jumps) - 1, -1, -1):
            far = (letter[at] > 0) & (letter[jumps[k][at]] > 0)
            length[far] += 1 << k
            at = np.where(far, jumps[k][at], at)
        open_ = letter[at] > 0
        length += open_
        final = np.where(open_, jumps[0][at], at)
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        at = np.repeat(start, length)
        for k in range(len(jumps)):
            at = np.where(place >> k & 1, jumps[k][at], at)
        return length, letter[at], (at - 1) % 4, np.where(final > 0, (final - 1) % 4, entry)


def _facts(rows: pd.DataFrame, conversation: np.ndarray) -> dict[str, np.ndarray]:
    """Faults and roles of rows in order; ``conversation`` numbers their conversations."""
    stripped = rows["text"].str.strip(_SPACE)
    blank = (stripped == "").to_numpy()
    if "seen" in rows:
        seen = rows["seen"].to_numpy()
    else:
        seen = pd.DataFrame({"c": conversation, "r": rows["role"], "t": rows["text"]}).duplicated().to_numpy()
    duplicate = seen & ~blank
    truncated = ~blank & ~duplicate & ~stripped.str[-1:].isin([".", "!", "?"]).to_numpy()
    role = rows["role"].str[:1].map({"s": 0, "u": 1, "a": 2}).fillna(3).to_numpy(np.int64)
    return {"blank": blank, "duplicate": duplicate, "truncated": truncated, "role": role}


def _illegal(role: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a row's initial may not follow that of the row ``before`` it."""
    return ~(((before == 0) & (role == 1)) | ((before == 1) & (role == 2)) | ((before == 2) & (role == 1)))


def _edited(letters: np.ndarray, states: np.ndarray, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The rows of one repaired conversation."""
    at = 0
    for letter, state in zip(letters.tolist(), states.tolist()):
        if letter == _I:
            yield _NAMES[_NEXT[state]], ""
            continue
        if letter == _K:
            yield roles[at], texts[at]
        elif letter == _R:
            yield _NAMES[_NEXT[state]], texts[at]
        at += 1


_REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string, roles array<string>, texts array<string>")


def _whole(rows: pd.DataFrame, texts: bool) -> pa.RecordBatch:
    """Report rows of whole conversations, which lie in order one after another."""
    ids = rows["conv_id"]
    fresh = ~(ids.eq(ids.shift()).fillna(False) | (ids.isna() & ids.shift().isna())).to_numpy(bool)
    fresh[0] = True
    number = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(rows)))
    facts = _facts(rows, number)
    repair = Repair(size, *_sides(facts), np.tile(_ACCEPTED, (len(size), 1)), True)
    length, letters, states, _ = repair.paths(np.zeros(len(size), np.int64))
    illegal = _illegal(facts["role"], np.roll(facts["role"], 1)) & ~fresh
    turns = rows["turn"].astype("Int64").groupby(number)
    least, most, kinds = turns.min(), turns.max(), turns.nunique()
    gaps = (most - least + 1 - kinds).fillna(0).astype("int64").to_numpy()
    counts = {c: np.bincount(number, facts[c], len(size)).astype(np.int64) for c in ("blank", "duplicate", "truncated")}
    ends = np.cumsum(length)
    codes = _LETTERS[letters]
    roles, words = rows["role"].tolist(), rows["text"].tolist()
    audits, hashes, all_roles, all_texts = [], [], [], []
    for i, (a, b, s, n) in enumerate(zip((ends - length).tolist(), ends.tolist(), first.tolist(), size.tolist())):
        fixed = list(_edited(letters[a:b], states[a:b], roles[s : s + n], words[s : s + n]))
        audits.append(codes[a:b].tobytes().decode())
        hashes.append(hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode("utf-8", "surrogatepass")).hexdigest())
        all_roles.append([r for r, _ in fixed] if texts else None)
        all_texts.append([t for _, t in fixed] if texts else None)
    strings = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids.iloc[first].astype("Int64")), pa.array(gaps), *(pa.array(c) for c in counts.values()),
         pa.array(np.bincount(number, illegal, len(size)).astype(np.int64)), pa.array(repair.start_costs()[:, START]), pa.array(audits),
         pa.array(hashes), pa.array(all_roles, strings), pa.array(all_texts, strings)],
        [part.split()[0] for part in _REPORT.split(", ")])


def _frames(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The sorted rows in frames of about BATCH_ROWS that never cut a run of equal ``keys``."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        frame = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        if not len(frame):
            continue
        held.append(frame)
        rows += len(frame)
        if rows < BATCH_ROWS:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = frame[keys].iloc[-1]
        same = pd.Series(True, frame.index)
        for key in keys:
            same &= (frame[key] == last[key]).fillna(False) if not pd.isna(last[key]) else frame[key].isna()
        cut = int((~same).sum())
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held, rows = [frame.iloc[cut:]], len(frame) - cut
    if rows:
        yield pd.concat(held, ignore_index=True)


def repair(rows: DataFrame, texts: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One report row per conv_id of ``rows`` (conv_id, turn, role, text; a null role
    or text is one space, other columns are not looked at) that has rows:
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, and with
    ``texts`` the repaired rows as ``roles`` and ``texts``.

    Rows are taken by turn, null turns first, equal turns by role and text. Rows
    without conv_id are one conversation. The cheapest edits that give role initials
    `(s?(ua)+)?` are found by a cost DP; of equally cheap ones the audit is the least,
    found by ranking the nodes of the optimal arcs by their next 1, 2, 4, ... letters.

    A conversation of up to ``block_rows`` rows is repaired by one task, with many
    others side by side. A longer one is cut into blocks: each gives its costs from
    state to state, these fix the costs after every block and the state every block
    starts from, then blocks are repaired apart. Only its digest, which has to read
    the repaired rows one after another, is a single stream, which holds one batch.
    Its ``roles`` and ``texts`` are null; ``long_rows`` has them as rows.
    """
    rows = filled(rows)
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    long_ids = cut_lineage(sizes.select(F.col("conv_id").alias("_long")))
    if long_ids.isEmpty():
        return _short(rows, texts)
    is_long = F.col("conv_id").eqNullSafe(F.col("_long"))
    # At most one id for each block_rows rows.
    return _short(rows.join(long_ids, is_long, "left_anti"), texts).unionByName(
        _long_report(rows.join(long_ids, is_long, "left_semi"), block_rows))


def _short(rows: DataFrame, texts: bool) -> DataFrame:
    order = ["conv_id", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _frames(batches, ["conv_id"]):
            yield _whole(frame, texts)

    return rows.repartition("conv_id").sortWithinPartitions(*[F.asc_nulls_first(c) for c in order]).mapInArrow(run, _REPORT)


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows of long conversations with their place, block, and whether an earlier row
    has the same role and text."""
    head = rows.withColumn("_head", F.substring("text", 1, 64)).withColumn("_turn", F.coalesce("turn", F.lit(-(1 << 63)).cast("long")))
    order = ["_turn", "role", "_head"]
    pieces = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    piece = _piece(order, _cut_points(head, order, min(pieces, 256)))
    numbered = row_numbers(head, ["_turn", "role", "text"], ["conv_id"], "place", pieces, F.coalesce(piece, F.lit(0)))
    numbered = cut_lineage(numbered.withColumn("place", F.col("place") - 1).withColumn("key", F.sha2(F.concat_ws("\0", "role", "text"), 256)))
    again = numbered.groupBy("conv_id", "key").agg(F.min("place").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A text that is said over and over is split by its row's block on its way to the join.
    salts = 16
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        F.col("conv_id").alias("_c"), F.col("key").alias("_k"), F.col("salt").alias("_s"), "origin")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")) & (F.pmod("place", F.lit(salts)) == F.col("_s"))
    marked = numbered.join(again, same, "left").select(
        "conv_id", "turn", "role", "text", "place", F.floor(F.col("place") / block_rows).cast("long").alias("block"),
        (F.coalesce(F.col("origin"), F.col("place")) < F.col("place")).alias("seen"))
    return cut_lineage(marked)


def _block_repairs(rows: DataFrame, kind: str, function, columns: list[str]) -> DataFrame:
    """``function`` over frames of whole blocks with the number of each row's block."""
    keys = ["conv_id", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _frames(batches, keys):
            fresh = np.ones(len(frame), bool)
            place, block = frame["place"].to_numpy(np.int64), frame["block"].to_numpy(np.int64)
            fresh[1:] = (place[1:] != place[:-1] + 1) | (block[1:] != block[:-1])
            first = np.flatnonzero(fresh)
            yield function(frame, first, np.diff(np.append(first, len(frame))))

    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "place").mapInArrow(run, kind)


def _with_states(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The blocks' rows with the costs after their block and the state it starts from,
    and one row per conversation with its cost."""

    def matrices(frame: pd.DataFrame, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        found, sides = [], _sides(_facts(frame, np.zeros(len(frame))))
        for end in range(4):
            last = np.full((len(size), 4), _FAR, np.int64)
            last[:, end] = 0
            found.append(Repair(size, *sides, last, False).start_costs())
        matrix = np.stack(found, axis=2).reshape(len(size), 16)
        return pa.RecordBatch.from_arrays(
            [pa.array(frame["conv_id"].iloc[first]), pa.array(frame["block"].iloc[first]), pa.array(matrix.tolist(), pa.list_(pa.int64()))],
            ["conv_id", "block", "costs"])

    columns = ["conv_id", "block", "place", "role", "text", "seen"]
    costs = cut_lineage(_block_repairs(rows, "conv_id long, block long, costs array<long>", matrices, columns))

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        steps = np.stack(pdf["costs"].to_numpy()).reshape(-1, 4, 4)
        after = np.zeros((len(steps), 4), np.int64)
        later = _states(_ACCEPTED[None])[0]
        for i in range(len(steps) - 1, -1, -1):
            after[i] = later
            later = np.minimum((steps[i] + later).min(axis=1), _FAR)
        return pd.DataFrame({"conv_id": pdf["conv_id"], "block": pdf["block"], "after": list(after), "cost": later[START]})

    # One short row per block_rows rows of a conversation.
    afters = cut_lineage(costs.groupBy("conv_id").applyInPandas(chain, "conv_id long, block long, after array<long>, cost long"))
    keyed = afters.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "after")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    return rows.join(F.broadcast(keyed), same).drop("_c", "_b"), afters


def _sides(facts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return facts["role"], facts["blank"] | facts["duplicate"], facts["truncated"]


def _lasts(frame: pd.DataFrame, first: np.ndarray) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in frame["after"].iloc[first]])


def _long_parts(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per block its letters and faults; the marked rows with their block's entry state; costs."""
    marked, afters = _with_states(_blocks(rows, block_rows), block_rows)
    columns = ["conv_id", "block", "place", "role", "text", "seen", "after"]

    def ways(frame: pd.DataFrame, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        facts = _facts(frame, np.zeros(len(frame)))
        repair = Repair(size, *_sides(facts), _lasts(frame, first), False)
        letters, ends = [], []
        for entry in range(4):
            length, found, _, final = repair.paths(np.full(len(size), entry))
            at = np.cumsum(length)
            letters.append([_LETTERS[found[a:b]].tobytes().decode() for a, b in zip(at - length, at)])
            ends.append(final)
        number = np.repeat(np.arange(len(size)), size)
        inner = _illegal(facts["role"], np.roll(facts["role"], 1))
        inner[first] = False
        counts = [np.bincount(number, facts[c], len(size)).astype(np.int64) for c in ("blank", "duplicate", "truncated")]
        counts.append(np.bincount(number, inner, len(size)).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(frame["conv_id"].iloc[first]), pa.array(frame["block"].iloc[first]),
             pa.array([list(x) for x in zip(*letters)], pa.list_(pa.string())), pa.array(np.stack(ends, axis=1).tolist(), pa.list_(pa.int64())),
             pa.array(facts["role"][first]), pa.array(facts["role"][first + size - 1]), *(pa.array(c) for c in counts)],
            ["conv_id", "block", "ways", "ends", "head", "tail", "blank", "duplicate", "truncated", "illegal"])

    kind = ("conv_id long, block long, ways array<string>, ends array<long>, head long, tail long, blank long, duplicate long, "
            "truncated long, illegal long")
    found = cut_lineage(_block_repairs(marked, kind, ways, columns))

    def entries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        state, out = START, []
        for ends in pdf["ends"]:
            out.append(state)
            state = int(ends[state])
        return pd.DataFrame({"conv_id": pdf["conv_id"], "block": pdf["block"], "entry": out, "final": state})

    chained = cut_lineage(found.select("conv_id", "block", "ends").groupBy("conv_id").applyInPandas(
        entries, "conv_id long, block long, entry long, final long"))
    keyed = F.broadcast(chained.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "entry", "final"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    return (found.join(keyed, same).drop("_c", "_b").withColumn("audit", F.element_at("ways", (F.col("entry") + 1).cast("int"))).drop("ways", "ends"),
            marked.join(keyed, same).drop("_c", "_b"), afters)


# Inserts that end a conversation from its last state, which no block holds.
_ENDINGS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _long_rows(marked: DataFrame) -> DataFrame:
    """(conv_id, place, step, role, text) of the repaired rows: step tells apart what
    stands at one place."""
    columns = ["conv_id", "block", "place", "role", "text", "seen", "after", "entry", "final", "is_last"]

    def edits(frame: pd.DataFrame, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        repair = Repair(size, *_sides(_facts(frame, np.zeros(len(frame)))), _lasts(frame, first), False)
        length, letters, states, _ = repair.paths(frame["entry"].iloc[first].to_numpy(np.int64))
        at, out = np.cumsum(length), []
        roles, texts = frame["role"].tolist(), frame["text"].tolist()
        for a, b, s, n in zip(at - length, at, first.tolist(), size.tolist()):
            conversation = frame["conv_id"].iloc[s]
            conversation = None if pd.isna(conversation) else int(conversation)
            begin = int(frame["place"].iloc[s])
            out += [(conversation, begin, i, r, t) for i, (r, t) in enumerate(_edited(letters[a:b], states[a:b], roles[s : s + n], texts[s : s + n]))]
            if bool(frame["is_last"].iloc[s]):
                ending = _ENDINGS[int(frame["final"].iloc[s])]
                fixed = [("user", "")] * (len(ending) == 2) + [("assistant", "")] * (len(ending) > 0)
                out += [(conversation, begin + n, i, r, t) for i, (r, t) in enumerate(fixed)]
        columns = list(zip(*out)) if out else [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
            ["conv_id", "place", "step", "role", "text"])

    return _block_repairs(marked, "conv_id long, place long, step long, role string, text string", edits, columns)


def _last_blocks(df: DataFrame) -> DataFrame:
    tops = F.broadcast(df.groupBy("conv_id").agg(F.max("block").alias("_top")).withColumnRenamed("conv_id", "_c"))
    return df.join(tops, F.col("conv_id").eqNullSafe(F.col("_c"))).withColumn("is_last", F.col("block") == F.col("_top")).drop("_c", "_top")


def _long_report(rows: DataFrame, block_rows: int) -> DataFrame:
    parts, marked, afters = _long_parts(rows, block_rows)

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        borders = _illegal(pdf["head"].to_numpy()[1:], pdf["tail"].to_numpy()[:-1]).sum() if len(pdf) > 1 else 0
        return pd.DataFrame({
            "conv_id": pdf["conv_id"].iloc[:1].astype("Int64"), **{c: [int(pdf[c].sum())] for c in ("blank", "duplicate", "truncated")},
            "illegal": [int(pdf["illegal"].sum() + borders)], "audit": ["".join(pdf["audit"]) + _ENDINGS[int(pdf["final"].iloc[0])]]})

    kind = "conv_id long, blank long, duplicate long, truncated long, illegal long, audit string"
    totals = parts.groupBy("conv_id").applyInPandas(total, kind)
    turns = marked.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1).alias("span"), F.countDistinct("turn").alias("kinds")).select(
        F.col("conv_id").alias("_t"), F.coalesce(F.col("span") - F.col("kinds"), F.lit(0)).alias("gaps"))
    costs = afters.groupBy("conv_id").agg(F.first("cost").alias("cost")).select(F.col("conv_id").alias("_k"), "cost")
    fixed = _long_rows(_last_blocks(marked)).repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None
        for batch in batches:
            for conversation, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or conversation != current:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([state.hexdigest()])], ["_h", "repaired_sha256"])
                    state, current = hashlib.sha256(), conversation
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([state.hexdigest()])], ["_h", "repaired_sha256"])

    hashes = fixed.mapInArrow(digest, "_h long, repaired_sha256 string")
    joined = totals
    for side, key in ((turns, "_t"), (costs, "_k"), (hashes, "_h")):
        how = "left" if key == "_h" else "inner"
        joined = joined.join(side, F.col("conv_id").eqNullSafe(F.col(key)), how).drop(key)
    names = [part.split()[0] for part in _REPORT.split(", ")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    empty = F.lit(None).cast(T.ArrayType(T.StringType()))
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing)).withColumn("roles", empty).withColumn(
        "texts", empty).select(*names)


def long_rows(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, place, step, role, text) of the repaired rows of conversations of any
    length, in order of place and step, block by block."""
    _, marked, _ = _long_parts(filled(rows), block_rows)
    return _long_rows(_last_blocks(marked))


def report(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The report of every conv_id of ``rows`` after they were ``damaged``; those that
    have no rows left get zeros, an empty audit and the hash of nothing."""
    found = repair(damaged(rows), False, block_rows).drop("roles", "texts")
    wanted = rows.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return wanted.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
