"""Packing: every id in one piece, full windows, related neighbours."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from newsweave.llm import packing, tokencounts

RANKS = tokencounts.rank_bytes("/opt/tokenizers/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    found.encode_special_tokens = True
    return found


def checked(rows, pieces, tokenizer):
    """Pieces must be the cut of the documents' ids, sequences gapless and at most a window."""
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]
    wanted, by_doc = defaultdict(list), defaultdict(list)
    for (doc, _), own in zip(rows, ids):
        wanted[doc].append(own)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    assert set(by_doc) == set(wanted)
    for doc, own in by_doc.items():
        assert sum(p["length"] for p in own) == sum(map(len, wanted[doc]))
        if len(wanted[doc]) > 1:
            continue
        at, held = 0, wanted[doc][0]
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(held)
            assert p["ids_crc32"] == zlib.crc32(held[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(held)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    open_ = []
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        if at < packing.WINDOW:
            open_.append(at)
    return open_


def test_pieces_of_the_given_documents(spark, folder, tokenizer):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(checked(rows, packing.pack(docs, RANKS).collect(), tokenizer)) <= 1


def test_nulls_long_texts_repeats_and_special_strings(spark, tokenizer):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (None, "no id"), (None, "no id"), (5, "same text here"), (5, "same text here"), (6, "<|endoftext|> <|endoftext|>"),
            (7, "word " * 400_000), (8, "x" * 1_000_000), (9, " ".join(rng.choice("abc") * rng.randint(1, 5) for _ in range(5000))), (10, "ünï 漢字 🙂" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as start", "2 as first", "3 as key")
    assert len(checked(rows, packing.pack(df, RANKS).collect(), tokenizer)) <= 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0


def test_many_shards_and_tasks(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 100)
    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.randint(0, 99)) for _ in range(rng.randint(1, 300)))) for i in range(300)] + [(1000 + i, "one and the same text") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(checked(rows, packing.pack(df, RANKS).collect(), tokenizer)) <= 5


def test_index_scores_equal_plain_bm25():
    rng = np.random.default_rng(5)
    items = [packing.Item(i, 0, 9, rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint32)) for i in range(50)]
    idf = rng.random(40) + 0.1
    shard = packing.Shard(items, idf, 12.0)
    for seed in range(50):
        query = sorted(set(items[seed].ids.tolist()), key=lambda t: (-idf[t], t))[: packing.QUERY_TOKENS]
        scores = [sum(idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x.ids) / 12.0)) for t in query if (f := x.ids.tolist().count(t))) for x in items]
        unused = rng.random(50) < 0.7
        found = shard.neighbours(seed, unused)
        assert set(found) == {i for i in range(50) if unused[i] and scores[i] > 0}
        assert np.allclose([scores[i] for i in found], sorted((scores[i] for i in found), reverse=True))


def test_neighbours_of_a_topic_share_windows(spark):
    rng = random.Random(6)
    topics = [[f"{a}{t}topic" for a in "abcdefghij"] for t in range(20)]
    rows = [(i, " ".join(rng.choice(topics[i % 20]) for _ in range(60))) for i in range(400)]
    found = defaultdict(list)
    for p in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), RANKS).collect():
        found[p["sequence_id"]].append(p["doc_id"] % 20)
    same = [sum(a == own[0] for a in own[1:]) / (len(own) - 1) for own in found.values() if len(own) > 1]
    assert sum(same) / len(same) > 0.6
