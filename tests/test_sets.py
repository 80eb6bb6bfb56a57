"""Bitmaps, screened ids and footers on edge rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsweave.operators import bitmaps
from newsweave.sinks.done import DoneIds, filter_of, merged, with_guess, words_for
from newsweave.sources import footers

ODD = [("U1", "N63"), ("U1", "N63"), ("U1", "N64"), ("U1", "N0"), ("U1", "N063"), ("U1", "63"), ("U1", ""), ("U1", None),
       ("U2", "N9223372036854775807"), ("U2", "N9223372036854775808"), ("U2", "N-1"), ("U2", "X7"), (None, "N5"), ("U3", None)]
PAIRS = "user_id string, news_id string"


def _rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_item_sets_come_back_as_they_were(spark):
    pairs = spark.createDataFrame(ODD, PAIRS)
    words = bitmaps.item_words(pairs)
    kept = sorted({p for p in ODD if p[1] is not None}, key=repr)
    assert _rows(bitmaps.items_of(words)) == kept
    counts = {}
    for user, _ in kept:
        counts[user] = counts.get(user, 0) + 1
    assert dict(bitmaps.item_counts(words).collect()) == counts
    halves = [bitmaps.item_words(spark.createDataFrame(ODD[i::2], PAIRS)) for i in range(2)]
    assert _rows(bitmaps.merged_words(*halves)) == _rows(words)
    assert bitmaps.items_of(bitmaps.item_words(pairs.limit(0))).count() == 0


def test_labels_by_bit_test(spark):
    words = bitmaps.item_words(spark.createDataFrame(ODD, PAIRS))
    asked = [("U1", "N63"), ("U1", "N62"), ("U1", "N063"), ("U1", "N0063"), ("U1", None), ("U2", "N-1"), ("U2", "X8"), ("U3", "N5"),
             (None, "N5"), ("U1", ""), ("U1", "N63"), ("U9", "N1"), ("U2", "N9223372036854775807")]
    found = bitmaps.with_label(spark.createDataFrame(asked, PAIRS).withColumn("other", F.lit("x")), words)
    assert found.columns == ["user_id", "news_id", "other", "label"]
    held = {p for p in ODD if None not in p}
    assert _rows(found) == sorted([(u, n, "x", int((u, n) in held)) for u, n in asked], key=repr)


def test_a_user_with_a_million_clicks(spark):
    clicks = spark.range(0, 1_000_000, numPartitions=8).select(
        F.lit("U1").alias("user_id"), F.concat(F.lit("N"), (F.col("id") * 3).cast("string")).alias("news_id"))
    words = bitmaps.item_words(clicks)
    assert words.count() == 3_000_000 // 64
    asked = spark.range(0, 300).select(F.lit("U1").alias("user_id"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("news_id"))
    assert bitmaps.with_label(asked, words).agg(F.sum("label")).first()[0] == 100
    assert bitmaps.item_counts(words).first()["items"] == 1_000_000


def test_id_sets(spark):
    left = [("U0",), ("U1",), ("U32768",), ("U32769",), ("U100000",), ("U01",), ("x",), (None,), ("U1",)]
    right = [("U0",), ("U32768",), ("U32769",), ("U99999",), ("U01",), ("y",), (None,)]
    a, b = [bitmaps.id_bitmaps(spark.createDataFrame(rows, "user_id string"), "user_id", "U") for rows in (left, right)]
    ids = {r[0] for r in left if r[0]}, {r[0] for r in right if r[0]}
    assert {r[0] for r in bitmaps.ids_of(a, "user_id", "U").collect()} == ids[0]
    both = bitmaps.common(a, b)
    assert sorted(r[0] for r in bitmaps.ids_of(both, "user_id", "U").collect()) == sorted(ids[0] & ids[1])
    assert bitmaps.size_of(both).first()["ids"] == len(ids[0] & ids[1])
    assert bitmaps.size_of(bitmaps.merged_bitmaps(a, b)).first()["ids"] == len(ids[0] | ids[1])
    none = bitmaps.id_bitmaps(spark.createDataFrame([], "user_id string"), "user_id", "U")
    assert bitmaps.size_of(bitmaps.common(a, none)).first()["ids"] == 0
    numbers = bitmaps.id_bitmaps(spark.range(5, 50), "id")
    assert bitmaps.size_of(numbers).first()["ids"] == 45


def test_filters_merge_and_miss_nothing(spark):
    ids = spark.range(0, 20_000).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("news_id"))
    words = words_for(20_000)
    whole = filter_of(ids, "news_id", words)
    parts = [filter_of(ids.where(F.crc32("news_id") % 3 == i), "news_id", words) for i in range(3)]
    assert _rows(merged(*parts)) == _rows(whole)
    assert with_guess(ids, whole, "news_id", words).where("not _maybe").count() == 0
    others = spark.range(50_000, 70_000).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("news_id"))
    assert with_guess(others, whole, "news_id", words).where("_maybe").count() < 1_000


def test_done_ids_grow_and_open_again(spark, tmp_path):
    root = str(tmp_path / "done")
    rows = spark.createDataFrame([(f"N{i}", i) for i in range(50)] + [(None, 1), ("", 2)], "news_id string, v int")
    store = DoneIds(spark, root, expected=1)
    assert store.not_yet(rows).count() == 52
    store.append(rows.where("v < 10"))
    store.append(rows.where("v < 12"))
    expected = sorted([r["news_id"] for r in rows.collect() if r["news_id"] and r["v"] >= 12])
    left = DoneIds(spark, root).not_yet(rows)
    assert left.columns == rows.columns
    assert sorted(r["news_id"] for r in left.where("news_id is not null").collect()) == expected
    assert left.where("news_id is null").count() == 1
    # Beyond the room of the smallest filter it is made anew, larger.
    many = spark.range(1_000, 10_000).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("news_id"))
    small = store.words()
    store.append(many)
    store.append(many.limit(1))
    assert store.words() > small
    assert store.not_yet(many).count() == 0
    assert sorted(r[0] for r in store.not_yet(rows).where("news_id is not null").select("news_id").collect()) == expected


@pytest.mark.parametrize("table", ["events", "orders"])
def test_footers_answer_counts(spark, folder, table):
    counted = footers.stored_rows(spark, f"{folder}/{table}.parquet")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert counted.first()["rows"] == spark.read.parquet(f"{folder}/{table}.parquet").count()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown", "false") == "false"


def test_footers_answer_bounds(spark, tmp_path):
    path, empty = str(tmp_path / "t"), str(tmp_path / "e")
    rows = spark.createDataFrame(
        [(1, None, 4, float("nan"), "x"), (None, None, -4, 2.0, "y"), (5, None, 9, 3.0, "z")], "a int, b int, c long, d double, e string")
    rows.repartition(3).write.parquet(path)
    rows.limit(0).write.parquet(empty)
    facts = footers.stored_bounds(spark, path, ["a", "b", "c", "e"])
    assert "PushedAggregation: [MIN(c), MAX(c)]" in facts._jdf.queryExecution().executedPlan().toString()
    assert tuple(facts.first()) == (3, 2, 1, 5, 0, None, None, 3, -4, 9, 3, "x", "z")
    assert footers.stored_bounds(spark, path, ["d"]).first()["low_d"] == 2.0
    assert tuple(footers.stored_bounds(spark, empty, ["a", "c"]).first()) == (0, 0, None, None, 0, None, None)
    ready = [dict(footers.stored_readiness(spark, {"t": p}, field).collect())["t"] for p, field in ((path, "b"), (path, "x"), (path, "a"), (empty, "a"))]
    assert ready == [False, False, True, False]
