"""Spelling variants against all pairs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from newsweave.llm import spellings

SCHEMA = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    counts = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                word = run.translate(LOW)
                h = zlib.crc32(f"{doc}:{word}".encode())
                counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
            run = ""
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def varied(seed, count, docs):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéßÖÿ×") for _ in range(rng.randint(5, 9))) for _ in range(count)]
    words = []
    for w in base:
        words += [w] * rng.randint(1, 60)
        for _ in range(4):
            p, kind = rng.randrange(len(w)), rng.random()
            c = rng.choice("abcdeéÿÀ")
            words += [w[:p] + w[p + 1 :] if kind < 0.3 else w[:p] + c + w[p:] if kind < 0.6 else w[:p] + c + w[p + 1 :]] * rng.randint(1, 20)
    rng.shuffle(words)
    step = -(-len(words) // docs)
    return [(i, rng.choice([" ", "-", "1", "\n"]).join(words[i * step : (i + 1) * step])) for i in range(docs)]


def test_words_equal_all_pairs(spark):
    rows = varied(1, 60, 40) + [(7, None), (8, ""), (9, "Ärger ärger ARGER " * 5), (9, "Ärger ärger ARGER " * 5)]
    found = spellings.variants(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as word", "1 as n", "2 as form"))
    assert {tuple(r) for r in found.collect()} == expected(rows)


def test_filters_in_many_shards_and_portions(spark, monkeypatch):
    monkeypatch.setattr(spellings, "SHARD_WORDS", 20)
    monkeypatch.setattr(spellings, "FILTER_BYTES", 80)
    rows = varied(2, 40, 20)
    assert {tuple(r) for r in spellings.variants(spark.createDataFrame(rows, SCHEMA)).collect()} == expected(rows)


def test_shards_that_go_over_several_batches(spark, monkeypatch):
    monkeypatch.setattr(spellings, "SHARD_WORDS", 20)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        rows = varied(3, 100, 20)
        assert {tuple(r) for r in spellings.variants(spark.createDataFrame(rows, SCHEMA)).collect()} == expected(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_long_words_and_chains(spark):
    long = "ab" * 30_000
    mixed = ["q" * 40] * 3 + ["q" * 41] * 6 + ["q" * 43] * 3
    words = ["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + [long] * 4 + [long + "c"] * 9 + mixed
    # Ids for which no run is damaged keep the counts plain.
    doc = next(i for i in range(500) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in set(words)))
    found = {r["word"]: r for r in spellings.variants(spark.createDataFrame([(doc, " ".join(words))], SCHEMA)).collect()}
    assert found["aaaaa"]["root"] == "abbbb" and found["aaaaa"]["form"] == "aaaab" and found["abbbb"]["form"] is None
    assert found[long]["form"] == long + "c" and found[long]["n_near"] == 1
    assert found["q" * 40]["form"] == "q" * 41 and found["q" * 43]["n_near"] == 0


def test_empty_tables(spark):
    assert spellings.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spellings.variants(spark.createDataFrame([(1, None), (None, "abcde " * 4)], SCHEMA)).count() <= 1


@pytest.mark.parametrize("count", [1, 1000, 50_000])
def test_filters_lose_no_word(count):
    rng = np.random.default_rng(count)
    held, other = rng.integers(0, 1 << 63, count).astype(np.uint64), rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    words = spellings.filled(held, max(-(-count * spellings.BITS // 512), 1))
    assert spellings.holds(words, held).all()
    assert spellings.holds(words, other).mean() < 0.02
