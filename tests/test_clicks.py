"""Click logs: the edge rows an operator must get right."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from newsweave.constants import BEHAVIORS_SCHEMA
from newsweave.functions.clicks import click_time, words
from newsweave.operators import behaviors as ops


def log(spark, *rows):
    return spark.createDataFrame(
        [(i, user, "11/13/2019 8:36:57 AM", history, shown) for i, (user, history, shown) in enumerate(rows)],
        BEHAVIORS_SCHEMA,
    )


def test_sample_row(spark):
    row = log(spark, ("U1", "N11 N21 N103", "N4-1 N34-1 N156-0 N207-0 N198-0"))
    assert [r.news_id for r in ops.history_items(row).collect()] == ["N11", "N21", "N103"]
    items = ops.interactions(row)
    assert sorted(r.newsId for r in ops.positives(items).collect()) == [4, 34]
    assert sorted(r.newsId for r in ops.negatives(items).collect()) == [156, 198, 207]


def test_null_and_empty_impressions_give_no_rows(spark):
    assert ops.interactions(log(spark, ("U1", None, None), ("U2", None, ""))).count() == 0


def test_item_without_label_counts_as_not_clicked(spark):
    row = ops.interactions(log(spark, ("U1", None, "N5"))).first()
    assert (row.newsId, row.clicked) == (5, 0)


def test_bad_ids_are_dropped_without_an_error(spark):
    items = ops.interactions(log(spark, ("Ux1", None, "N5-1"), ("U1", None, "Nx-1 N6-1"))).collect()
    assert [(r.userId, r.newsId) for r in items] == [(1, 6)]


def test_history_without_empty_items_and_with_repeats(spark):
    rows = ops.history_items(log(spark, ("U1", "N1  N2 N1", None), ("U2", None, None), ("U3", "", None)))
    assert [(r.user_id, r.news_id) for r in rows.collect()] == [("U1", "N1"), ("U1", "N2"), ("U1", "N1")]


def test_words_splits_on_any_whitespace(spark):
    row = spark.createDataFrame([(" a\tb  c\n",)], "t string").select(words(F.col("t")).alias("w")).first()
    assert row.w == ["a", "b", "c"]


def test_click_time(spark):
    row = log(spark, ("U1", None, None)).select(click_time(F.col("time")).alias("t")).first()
    assert row.t == datetime(2019, 11, 13, 8, 36, 57)
    bad = spark.createDataFrame([("yesterday",)], "time string").select(click_time(F.col("time")).alias("t")).first()
    assert bad.t is None


def test_at_most_npratio_negatives_per_user(spark):
    rows = log(spark, ("U1", None, " ".join(f"N{i}-0" for i in range(10)) + " N99-1"), ("U2", None, "N1-0 N2-1"))
    sample = ops.training_sample(rows)
    counts = {(r.userId, r.clicked): r["count"] for r in sample.groupBy("userId", "clicked").count().collect()}
    assert counts == {(1, 0): 4, (1, 1): 1, (2, 0): 1, (2, 1): 1}
    assert sorted(sample.collect()) == sorted(ops.training_sample(rows).collect())
    assert sorted(sample.collect()) != sorted(ops.training_sample(rows, seed=1).collect())


def test_negatives_per_positive(spark):
    rows = log(spark, ("U1", None, " ".join(f"N{i}-0" for i in range(10)) + " N98-1 N99-1"), ("U2", None, "N1-0"))
    sample = ops.training_sample(rows, npratio=2, per_positive=True)
    counts = {(r.userId, r.clicked): r["count"] for r in sample.groupBy("userId", "clicked").count().collect()}
    assert counts == {(1, 0): 4, (1, 1): 2}


def test_split_is_repeatable_and_near_the_ratio(spark):
    df = spark.range(5000)
    train, test = ops.repeatable_split(df, ["id"])
    assert train.count() + test.count() == 5000
    assert abs(train.count() / 5000 - 0.8) < 0.03
    assert train.intersect(test).isEmpty()


def test_ground_truth_keeps_users_without_clicks(spark):
    rows = log(spark, ("U1", None, "N2-1 N1-1 N3-0"), ("U1", None, "N1-1"), ("U2", None, "N1-0"), ("U3", None, None))
    truth = {r.user_id: r.relevant for r in ops.ground_truth(rows).collect()}
    assert truth == {"U1": ["N1", "N2"], "U2": [], "U3": []}


def test_first_behavior_is_the_lowest_impression(spark):
    rows = log(spark, ("U1", "N1", None), ("U1", "N2", None), ("U2", None, None))
    first = {r.user_id: r.history for r in ops.first_behaviors(rows).collect()}
    assert first == {"U1": "N1", "U2": ""}
