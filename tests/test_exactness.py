"""Rows that tie, keys that are null or hot, vectors that aren't finite, and tables
that are rewritten in part."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from newsweave.functions.intervals import interval_number, intervals_of
from newsweave.operators import corpus, joins, ranking, recommendations, similarity
from newsweave.operators.vectors import parsed
from newsweave.session import new_folder
from newsweave.sinks import writers
from newsweave.sinks.versions import read_current


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_last_wins_does_not_depend_on_partitions(spark, parts):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z"), ("b", 2, None), ("b", 2, "q")]
    frame = spark.createDataFrame(rows * 3, "k string, o int, v string")
    expected = sorted(corpus.last_wins(frame.coalesce(1), "k", ["o"]).collect())
    assert sorted(corpus.last_wins(frame.repartition(parts, "v"), "k", ["o"]).collect()) == expected
    assert [r.o for r in expected] == [1, 2]


def test_exactly_one_row_of_a_key_is_accepted(spark):
    rows = spark.createDataFrame([("k", 1, "x")] * 3 + [("k", 1, "y"), (None, 1, "z"), ("m", 2, "w")], "k string, o int, v string")
    path = new_folder(spark, "insert")
    rejected = writers.insert_past_errors(rows, path, "k", ["o"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["k", "m"]
    assert sorted(r.reason for r in rejected.collect()) == ["null key"] + ["repeated key"] * 3


def files_of(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_upsert_leaves_other_buckets_alone(spark):
    root = new_folder(spark, "upsert")
    writers.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")), root, "k")
    before = files_of(root)
    source = spark.createDataFrame([(5, "new", 1), (900, "new", 2)], "k long, v string, w int")
    table = writers.upsert(source, root, "k")
    after = files_of(root)
    assert before.items() <= after.items()
    touched = {r[0] for r in source.select(F.pmod(F.xxhash64("k"), F.lit(writers.MIN_BUCKETS))).collect()}
    assert {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} == {str(t) for t in touched}
    found = {r.k: (r.v, r.w) for r in table.collect()}
    assert len(found) == 201 and found[5] == ("new", 1) and found[900] == ("new", 2) and found[6] == ("old", None)
    assert read_current(spark, root).count() == 201
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            writers.upsert(spark.createDataFrame(bad, "k long, v string"), root, "k")


def test_a_broadcast_upsert_does_not_shuffle_the_target(spark, monkeypatch):
    root = new_folder(spark, "upsert")
    writers.upsert(spark.range(5000).select(F.col("id").alias("k"), F.lit("old").alias("v")), root, "k")
    plans = []
    write = writers.write_next
    monkeypatch.setattr(writers, "write_next", lambda df, *rest: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *rest)))
    source = spark.range(10).select((F.col("id") * 900).alias("k"), F.lit("new").alias("v"))
    writers.upsert(source, root, "k")

    def above_scans(plan):
        # The operators above each file scan, up to the first exchange that shuffles.
        lines, found = plan.splitlines(), []
        for at, line in enumerate(lines):
            if "FileScan" in line:
                depth, own = line.index("FileScan"), []
                for upper in reversed(lines[:at]):
                    place = len(upper) - len(upper.lstrip(" :+-"))
                    if place < depth and upper.strip(" :+-"):
                        own.append(upper.strip(" :+-*()0123456789"))
                        depth = place
                found.append(own)
        return found

    (plan,) = plans
    assert "FileScan" in plan
    for own in above_scans(plan):
        # Either rows on their way to be written, or the target's keys, cut to the source's first.
        shuffled = [i for i, x in enumerate(own) if x.startswith("Exchange")]
        semi = [i for i, x in enumerate(own) if "LeftSemi" in x]
        assert not shuffled or (semi and semi[0] < shuffled[0])


def test_upserts_of_any_size_agree(spark, monkeypatch):
    """Broadcast, shuffled, and dealt anew over more buckets or because of many files."""
    tables = []
    for budget, bucket_bytes, files in ((1 << 28, 1 << 26, 4), (0, 1 << 26, 4), (1 << 28, 4000, 4), (1 << 28, 1 << 26, 0)):
        monkeypatch.setattr(writers, "BUCKET_BYTES", bucket_bytes)
        monkeypatch.setattr(writers, "MOST_FILES", files)
        root = new_folder(spark, "upsert")
        for step in range(4):
            rows = spark.range(step * 400, step * 400 + 800).select(F.col("id").alias("k"), F.lit(f"step {step}").alias("v"))
            rows = rows.withColumn("w", F.lit(step)) if step == 2 else rows
            table = writers.upsert(rows, root, "k", budget)
        tables.append(sorted(map(tuple, table.collect())))
    assert len(tables[0]) == 2000 and all(t == tables[0] for t in tables)
    assert (850, "step 2", 2) in tables[0] and (1300, "step 3", 2) in tables[0] and (0, "step 0", None) in tables[0]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_null_keys_match_where_asked(spark, how):
    big = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)] * 50, "k string, n int")
    small = spark.createDataFrame([(None, "none"), ("a", "one")], "k string, v string")
    found = joins.salted_join(big, small, "k", how, hot_rows=10, null_safe=True)
    assert found.columns == ["k", "n", "v"]
    counts = {(r.k, r.v): r["count"] for r in found.groupBy("k", "v").count().collect()}
    assert counts == {(None, "none"): 100, ("a", "one"): 50} | ({("b", None): 50} if how == "left" else {})
    plain = joins.salted_join(big, small, "k", how, hot_rows=10)
    assert plain.count() == (200 if how == "left" else 50) and plain.where("v = 'none'").isEmpty()


def test_a_very_hot_key_gets_salts_by_its_size(spark):
    big = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"), "id")
    small = big.select("k").distinct().withColumn("v", F.length("k"))
    joined = joins.salted_join(big, small, "k", hot_rows=40)
    assert joined.count() == 5000 and joined.where("v <> length(k)").isEmpty()


def test_top_k_is_cut_before_the_shuffle_for_large_k(spark):
    frame = spark.range(20_000).select((F.col("id") % 2).alias("g"), "id")
    assert "WindowGroupLimit" in ranking.top_k(frame, "g", [F.col("id")], 500)._jdf.queryExecution().toString()
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", None)
    found = ranking.top_k(frame, "g", [F.desc("id")], 5000)
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", None) == before
    # Beyond the threshold groups are dealt over tasks first.
    assert "_share" in found._jdf.queryExecution().toString()
    assert found.count() == 10_000 and found.where("id < 10000").isEmpty() and found.agg(F.max("rank")).first()[0] == 5000


def test_more_ranges_than_an_expression_holds(spark):
    frame = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("o"), "id", (F.col("id") % 3).alias("g"))
    numbered = ranking.row_numbers(frame, ["o", "id"], pieces=300)
    assert [r.row_num for r in numbered.orderBy("o", "id").collect()] == list(range(1, 3001))
    grouped = ranking.row_numbers(frame, ["o", "id"], ["g"], pieces=300).collect()
    for g in range(3):
        own = sorted((r for r in grouped if r.g == g), key=lambda r: (r.o, r.id))
        assert [r.row_num for r in own] == list(range(1, 1001))


def test_complete_ranking_of_predictions(spark):
    rows = [(u, i, float(i % 4)) for u in (1, 2) for i in range(30)]
    frame = spark.createDataFrame(rows, "userId int, newsId int, prediction double")
    found = {(r.userId, r["rank"]): r.newsId for r in recommendations.ranked_predictions(frame).collect()}
    order = [i for _, i in sorted((-float(i % 4), i) for i in range(30))]
    assert found == {(u, n): i for u in (1, 2) for n, i in enumerate(order, 1)}


@pytest.mark.parametrize("budget", [0, 64 << 20])
def test_vectors_that_are_not_finite_take_no_part(spark, budget):
    good = [(f"a{i}", [float(i + 1), 1.0]) for i in range(30)]
    bad = [("nan", [float("nan"), 1.0]), ("inf", [float("inf"), 1.0]), ("null", None), ("hole", [None, 1.0]), ("empty", [])]
    articles = spark.createDataFrame(good + bad, "news_id string, embedding array<double>")
    users = spark.createDataFrame([("u", [1.0, 0.0]), ("v", [0.0, 1.0]), ("w", [float("nan"), 0.0]), ("x", None)], "user_id string, user_embedding array<double>")
    found = similarity.top_articles(users, articles, budget=budget).collect()
    assert len(found) == 20 and {r.user_id for r in found} == {"u", "v"} and not {r.news_id for r in found} & {b for b, _ in bad}
    texts = spark.createDataFrame([("NaN,1",), ("Infinity,2",), ("1,2",), (None,), ("",), ("-Infinity",)], "embedding_string string")
    assert [list(r.embedding) for r in parsed(texts).collect()] == [[1.0, 2.0]]


def test_products_in_pieces_give_the_same(monkeypatch):
    import numpy as np

    generator = np.random.default_rng(1)
    users, items = generator.normal(size=(40, 6)), generator.normal(size=(900, 6))
    items[100:200] = items[0]
    whole = similarity._best(users, items, 10)
    monkeypatch.setattr(similarity, "PRODUCT_BYTES", 40 * 8 * 50)
    for a, b in zip(whole, similarity._best(users, items, 10)):
        assert (a == b).all()


def test_short_ranges_and_their_columns(spark):
    start = datetime.datetime(2024, 1, 1)
    bounds = spark.createDataFrame([(1, start, start + datetime.timedelta(seconds=3)), (2, start, start)], "id int, start timestamp, end timestamp")
    found = intervals_of(bounds, 10)
    assert found.columns == ["id", "start", "end", "interval", "interval_start", "interval_end"] and found.count() == 20
    numbers = bounds.select(interval_number(F.col("end"), F.col("start"), F.col("end"), 10).alias("n")).collect()
    assert [r.n for r in numbers] == [9, 9]


def test_histories_are_complete_beyond_65536_events(spark, tmp_path):
    from newsweave.catalog import fixtures

    events = spark.range(70_000).select(
        F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.lit("click").alias("event_type"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id div 35000 as int))").alias("ts"),
        F.concat(F.lit('{"k": '), F.col("id") % 50, F.lit("}")).alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    log = fixtures.behaviors(spark, str(tmp_path))
    second = log.where("d = date'2024-01-02'").select(F.sum(F.size(F.split("history", " ")))).first()[0]
    assert log.count() == 6 and second == 35_000
