"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest

from newsweave.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def planted(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        row = (conv, turn, "user" if fault == 4 else role, text)
        out += [row, row] if fault == 3 else [row]
    return out


def searched(rows):
    """(faults, cost, audit, repaired rows) by Dijkstra over (cost, letters)."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        stripped = text.strip(SPACE)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, made = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return faults, cost, audit, list(made)
        for role in ("user", "assistant"):
            if (state, role[0]) in follows:
                heapq.heappush(queue, (cost + 3, audit + "I", at, role[0], (*made, (role, ""))))
        if at == len(rows):
            continue
        heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, made))
        if faults[at] in ("blank", "duplicate"):
            continue
        role, text, extra = rows[at][2], rows[at][3], 3 if faults[at] == "truncated" else 0
        if (state, role[:1]) in follows:
            heapq.heappush(queue, (cost + extra, audit + "K", at + 1, role[:1], (*made, (role, text))))
        for other in ("user", "assistant"):
            if (state, other[0]) in follows:
                heapq.heappush(queue, (cost + 3 + extra, audit + "R", at + 1, other[0], (*made, (other, text))))


def expected(rows):
    ids = {r[0] for r in rows}
    held = {i: [] for i in ids}
    for row in planted(rows):
        held[row[0]].append(row)
    found = {}
    for conv, own in held.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, cost, audit, made = searched(own)
        turns = {r[1] for r in own if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return found


def made_up(seed, conversations_, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "ok", "", " \t", "Well?", None, "what is it. ", "a\nb", "ünd…", "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "System"]
    return [(conv, rng.choice([i, i, i, i + 1, None]), rng.choice(roles), rng.choice(texts))
            for conv in [*range(conversations_), None] for i in range(rng.randint(1, longest))]


@pytest.mark.parametrize("block_rows", [conversations.BLOCK_ROWS, 4])
def test_reports_equal_a_search_over_all_edits(spark, block_rows):
    rows = made_up(block_rows, 120 if block_rows > 4 else 25, 14)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r[0]: tuple(r)[1:] for r in conversations.report(df, block_rows).collect()}
    assert found == expected(rows)


def test_repaired_rows_are_given_as_rows_too(spark):
    rows = made_up(9, 12, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    short = {r["conv_id"]: list(zip(r["roles"], r["texts"])) for r in conversations.repair(df).collect()}
    sizes = {c: sum(r[0] == c for r in rows) for c in {r[0] for r in rows}}
    long = {}
    for r in sorted(conversations.long_rows(df, 3).collect(), key=lambda r: (r["place"], r["step"])):
        long.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert {c: short[c] for c in sizes} == {c: long.get(c, []) for c in sizes}


def test_a_long_conversation_and_clashing_columns(spark):
    rows = [(7, i, "user" if i % 3 else "assistant", f"say {i}." if i % 5 else "again and again") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.selectExpr("*", "'x' as audit", "1 as _fault", "2 as place", "3 as block", "4 as _long", "5 as _copies")
    whole, cut = conversations.report(wide).collect(), conversations.report(wide, 256).collect()
    assert whole == cut and len(whole) == 1


def test_empty_tables_and_conversations_without_rows(spark):
    assert conversations.report(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = conversations.report(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
