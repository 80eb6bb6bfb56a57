"""Joins, row numbers, corpus operators, sources and sinks on small tables."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from newsweave.functions.intervals import time_intervals
from newsweave.operators import corpus, joins, ranking
from newsweave.plans.ingest import load_crawled
from newsweave.session import cut_lineage, new_folder
from newsweave.sinks import writers
from newsweave.sinks.versions import read_current, versions
from newsweave.sources import tables

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    # One key owns a third of the rows.
    big = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v")
    )
    small = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    expected = sorted(big.join(small, "k", how).collect())
    assert sorted(joins.salted_join(big, small, "k", how, hot_rows=50).collect()) == expected
    for budget in (0, 1 << 20):
        assert sorted(joins.lookup_join(big, small, "k", how, budget=budget).collect()) == expected


def test_salts_spread_a_hot_key(spark):
    big = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(1, "a")], "k int, w string")
    plan = joins.salted_join(big, small, "k", hot_rows=10)
    assert plan.count() == 1000
    salt = F.pmod(F.xxhash64("k", "v"), F.lit(16))
    assert big.select(salt).distinct().count() == 16


def test_table_bytes_counts_strings_and_vectors(spark):
    df = spark.createDataFrame([("abc", [1.0, 2.0], 5), (None, None, None)], "s string, v array<double>, n int")
    assert 60 <= joins.table_bytes(df) <= 200


@SLOW
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 30)), min_size=1, max_size=120), st.integers(1, 9))
def test_row_numbers_equal_a_window(spark, rows, pieces):
    df = spark.createDataFrame([(i, g, o) for i, (g, o) in enumerate(rows)], "id int, g string, o int")
    found = {r.id: r.n for r in ranking.row_numbers(df, ["o", "id"], ["g"], "n", pieces).collect()}
    overall = {r.id: r.n for r in ranking.row_numbers(df, ["o", "id"], out="n", pieces=pieces).collect()}
    order = sorted((o, i) for i, (_, o) in enumerate(rows))
    assert overall == {i: n for n, (_, i) in enumerate(order, 1)}
    for group in {g for g, _ in rows}:
        members = sorted((o, i) for i, (g, o) in enumerate(rows) if g == group)
        assert [found[i] for _, i in members] == list(range(1, len(members) + 1))


def test_row_numbers_with_nulls(spark):
    df = spark.createDataFrame([("x", None), (None, "b"), (None, "a"), ("x", "c")], "g string, o string")
    found = sorted((r.g or "", r.o or "", r.n) for r in ranking.row_numbers(df, "o", ["g"], "n", 3).collect())
    assert found == [("", "a", 1), ("", "b", 2), ("x", "", 1), ("x", "c", 2)]


def paged_by_hand(rows, cap, page_size, max_pages):
    """The loop the operator stands for: rows (topic, source, place, id)."""
    kept = set()
    for topic in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == topic), key=lambda r: r[2])
        counts, excluded = {}, set()
        for page in range(-(-len(members) // page_size)):
            if max_pages is not None and page >= max_pages:
                break
            for _, source, _, key in members[page * page_size:(page + 1) * page_size]:
                if source is None or source not in excluded:
                    kept.add(key)
                if source is not None:
                    counts[source] = counts.get(source, 0) + 1
            excluded |= {s for s, n in counts.items() if n > cap}
    return kept


@pytest.mark.parametrize("max_pages", [None, 3])
def test_page_cap_equals_the_loop(spark, max_pages):
    random.seed(5)
    rows = [
        (random.choice("ab"), random.choice(["s1", "s1", "s1", "s2", "s3", None]), random.random(), i)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "topic string, source string, place double, id int")
    found = corpus.capped_sources(df, ["topic"], "source", ["place", "id"], 12, 20, max_pages)
    assert {r.id for r in found.collect()} == paged_by_hand(rows, 12, 20, max_pages)


def test_last_wins_and_missing_keys(spark):
    first = spark.createDataFrame([("a", "1"), ("b", "1"), (None, "1"), ("", "1")], "news_id string, t string")
    second = spark.createDataFrame([("a", "2")], "news_id string, t string")
    assert {(r.news_id, r.t) for r in tables.latest_news(first, second).collect()} == {("a", "2"), ("b", "1")}


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "y int")
    assert sorted(corpus.union_all(a, b).collect(), key=str) == [(1, 2), (None, 3)]


def test_duplicate_titles(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "a"), ("2", "c"), ("3", None)], "_id string, title string")
    assert sorted(corpus.duplicate_titles(df).collect()) == [("1", "a", 2, 3), ("1", "b", 1, 3)]


def test_intervals(spark):
    rows = time_intervals(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1, 40), 3).collect()
    assert [(r.interval_start[-8:], r.interval_end[-8:]) for r in rows] == [
        ("00:00:00", "00:00:32"), ("00:00:33", "00:01:05"), ("00:01:06", "00:01:40"),
    ]


def test_articles_without_source_stay(spark):
    df = spark.createDataFrame(
        [("world", "2024-01-02", None), ("world", "2024-01-02", "yahoo.com"), ("sport", "2024-01-02", "a"), ("world", "2025-01-02", "a")],
        "topic string, published string, source string",
    )
    found = corpus.selected_articles(df, ["world", "politics"], F.lit("2024-01-01"), F.lit("2024-12-31"))
    assert [r.source for r in found.collect()] == [None]


def test_tsv_keeps_quotes_and_reads_null_tokens(spark):
    path = new_folder(spark, "tsv")
    spark.createDataFrame([('1\tU1\tt\t\t"N3-1',), ("2\tNA\tt\tN1\tN2-0",)], "value string").write.text(path)
    rows = sorted(tables.read_behaviors(spark, path, null_tokens=["NA"]).collect())
    assert [tuple(r) for r in rows] == [(1, "U1", "t", None, '"N3-1'), (2, None, "t", "N1", "N2-0")]


def test_readiness(spark):
    empty = spark.createDataFrame([(None,)], "_id string")
    full = spark.createDataFrame([("a",)], "_id string")
    found = {r.table_name: r.ready for r in tables.readiness({"empty": empty, "full": full}, "_id").collect()}
    assert found == {"empty": False, "full": True}
    with pytest.raises(ValueError, match="empty"):
        tables.require_ready({"empty": empty, "full": full}, "_id")


def test_upsert_sets_named_columns_only(spark):
    root = new_folder(spark, "upsert")
    writers.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string"), root, "k")
    source = spark.createDataFrame([("a", None), ("c", 3)], "k string, n int")
    expected = [("a", None, "x"), ("b", 2, "y"), ("c", 3, None)]
    for _ in range(2):
        assert sorted(tuple(r) for r in writers.upsert(source, root, "k").collect()) == expected
    assert versions(spark, root) == [1, 2, 3]
    assert read_current(spark, new_folder(spark, "none")) is None


def test_insert_goes_on_past_bad_rows(spark):
    path = new_folder(spark, "insert")
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, n int")
    first = writers.insert_past_errors(rows, path, "k", ["n"])
    assert sorted((r.n, r.reason) for r in first.collect()) == [(2, "repeated key"), (3, "null key")]
    again = writers.insert_past_errors(rows, path, "k", ["n"])
    assert {r.reason for r in again.collect()} == {"existing key", "null key"}
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 4]


def test_load_only_when_empty(spark):
    path = new_folder(spark, "load")
    df = spark.range(3)
    assert writers.load_if_empty(df, path) and not writers.load_if_empty(df, path)
    assert spark.read.parquet(path).count() == 3


def test_crawl_is_merged(spark):
    schema = "_id string, title string, summary string"
    first = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x")], schema)
    second = spark.createDataFrame([("1", "c", "y")], schema)
    path = new_folder(spark, "crawl")
    report, rejected = load_crawled(first, second, path)
    assert sorted(r.title for r in report.collect()) == ["a", "c"] and rejected.isEmpty()
    assert sorted((r._id, r.title, r.link) for r in spark.read.parquet(path).collect()) == [("1", "c", None), ("2", "b", None)]


def test_json_arrays_with_missing_fields(spark, tmp_path):
    (tmp_path / "crawl.json").write_text('[{"_id": "1", "title": "a"}, {"_id": "2", "link": "l"}]')
    rows = tables.read_articles(spark, str(tmp_path / "crawl.json")).collect()
    assert sorted((r._id, r.title, r.link) for r in rows) == [("1", "a", None), ("2", None, "l")]


def test_cut_lineage_keeps_rows(spark):
    assert cut_lineage(spark.range(10)).count() == 10
