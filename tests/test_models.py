"""Properties of results that depend on a solver, metrics, jobs, the stream."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import RankingEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from newsweave.catalog import fixtures as fx
from newsweave.operators import clustering, evaluation, factorization, inner_products
from newsweave.operators.behaviors import training_samples
from newsweave.plans.cluster import cluster_job
from newsweave.plans.collaborative import collaborative_job
from newsweave.session import new_folder
from newsweave.sources.tables import ClusterInput
from newsweave.streaming import incremental


@pytest.fixture(scope="module")
def samples(spark, folder):
    train, valid = training_samples(fx.behaviors_train(spark, folder), fx.behaviors_valid(spark, folder))
    return train.persist(), valid.persist()


def test_regression_metrics_equal_the_evaluator(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.25), (1, 1.5)], "clicked int, prediction double")
    row = evaluation.regression_metrics(df).first()
    for name in ("rmse", "mae"):
        expected = RegressionEvaluator(metricName=name, labelCol="clicked").evaluate(df)
        assert row[name] == pytest.approx(expected)


def test_ranking_metrics_equal_the_evaluator(spark):
    recs = spark.createDataFrame(
        [("u", n, 0.0, r) for r, n in enumerate("abcde", 1)] + [("v", n, 0.0, r) for r, n in enumerate("xyz", 1)]
        + [("w", "a", 0.0, 1), ("nobody", "a", 0.0, 1)],
        "user_id string, news_id string, similarity_score double, rank long",
    )
    pairs = spark.createDataFrame(
        [("u", "b"), ("u", "e"), ("u", "q"), ("v", "x"), ("v", None), ("w", None)], "user_id string, news_id string"
    )
    means = evaluation.mean_ranking_metrics(evaluation.ranking_metrics(recs, pairs, 5)).first()
    assert means["users"] == 3
    lists = spark.createDataFrame(
        [(list("abcde"), list("beq")), (list("xyz"), ["x"]), (["a"], [])], "prediction array<string>, label array<string>"
    )
    to_numbers = lambda c: F.transform(c, lambda x: F.ascii(x).cast("double"))
    lists = lists.select(to_numbers("prediction").alias("prediction"), to_numbers("label").alias("label"))
    for name, metric in (
        ("precision_at_k", "precisionAtK"), ("recall_at_k", "recallAtK"), ("ndcg_at_k", "ndcgAtK"),
        ("mean_average_precision", "meanAveragePrecision"),
    ):
        assert means[name] == pytest.approx(RankingEvaluator(metricName=metric, k=5).evaluate(lists)), name


def test_same_seed_same_error(samples):
    train, valid = samples
    errors = [
        evaluation.regression_metrics(
            factorization.predictions(factorization.als_estimator(rank=5, maxIter=2).fit(train), valid)
        ).first()["rmse"]
        for _ in range(2)
    ]
    assert errors[0] == pytest.approx(errors[1], abs=1e-6)


def test_recommendations_are_ranked_without_gaps(samples):
    model = factorization.als_estimator(rank=5, maxIter=2).fit(samples[0])
    flat = factorization.flat_recommendations(factorization.recommendations(model, 7))
    per_user = flat.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "similarity_score"))).alias("r"))
    for row in per_user.collect():
        assert [x["rank"] for x in row.r] == list(range(1, 8))
        scores = [x["similarity_score"] for x in row.r]
        assert scores == sorted(scores, reverse=True)


def test_convergence_curve(samples):
    curve, model = factorization.convergence(*samples, iterations=2, rank=5)
    assert [r.iteration for r in curve.orderBy("iteration").collect()] == [1, 2]
    assert model.rank == 5


def test_grid_covers_all_points_best_first(samples):
    table, found = factorization.grid_search(samples[0], [2, 3], [0.1], [1.0], folds=2, parallelism=2, maxIter=1)
    rows = table.collect()
    assert {r["rank"] for r in rows} == {2, 3} and rows[0].rmse <= rows[1].rmse
    assert found.bestModel.rank == rows[0]["rank"]


def test_missing_model_is_an_error():
    with pytest.raises(Exception):
        factorization.load_model("/tmp/no-such-model")


def test_collaborative_job_needs_data(spark, folder):
    train = fx.behaviors_train(spark, folder)
    with pytest.raises(ValueError, match="behaviors_valid"):
        collaborative_job(train, train.limit(0))


def test_components_are_centred(spark, folder):
    reduced, _ = clustering.centred_pca(fx.article_vectors(spark, folder), 5)
    means = reduced.select(*[F.avg(F.get("pca_embedding", i)) for i in range(5)]).first()
    assert all(abs(m) < 1e-9 for m in means)


def test_best_start_has_the_lowest_cost(spark, folder):
    reduced, _ = clustering.centred_pca(fx.article_vectors(spark, folder), 5)
    labelled, model, costs = clustering.best_kmeans(reduced, starts=3)
    assert model.summary.trainingCost == min(costs) and len(costs) == 3
    assert {r.cluster for r in labelled.select("cluster").distinct().collect()} == {0, 1, 2}


def test_missing_category_is_unknown(spark):
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("c", [1.0])], "news_id string, embedding array<double>")
    news = spark.createDataFrame([("a", "sport"), ("b", None), (None, "x")], "news_id string, category string")
    found = {r.news_id: r.category for r in clustering.with_category(vectors, news).collect()}
    assert found == {"a": "sport", "b": "unknown", "c": "unknown"}


def test_category_table_fills_zeros(spark):
    counts = clustering.category_counts(spark.createDataFrame(
        [(0, "a"), (0, "a"), (1, "b"), (1, None), (None, "a")], "cluster int, category string"
    ))
    rows = {r.cluster: (r.a, r.b) for r in clustering.category_table(counts).collect()}
    assert rows == {0: (2, 0), 1: (0, 1)}


def test_cluster_job_reuses_only_the_same_input(spark, folder):
    root = new_folder(spark, "cluster")
    vectors = fx.article_vectors(spark, folder).select("news_id", "embedding")
    news = fx.news(spark, folder)
    run = lambda v: cluster_job(
        ClusterInput(v, news), components=4, starts=1, cache_root=f"{root}/cache", output_root=f"{root}/out"
    )
    whole = run(vectors)
    assert whole.clusters.count() == vectors.count() and sum(r["count"] for r in whole.counts.collect()) == vectors.count()
    run(vectors)
    files = spark._jvm.java.io.File(f"{root}/cache").list()
    assert len(list(files)) == 1
    run(vectors.filter("news_id <> 'N1'"))
    assert len(list(spark._jvm.java.io.File(f"{root}/cache").list())) == 2


def test_stream_keeps_first_arrivals_through_replays_and_restarts(spark, monkeypatch):
    root = new_folder(spark, "stream")
    tokens = spark.createDataFrame([("one", [1.0, 0.0]), ("two", [0.0, 1.0])], "token string, vector array<float>")
    schema = "news_id string, title string, abstract string"
    fields = spark.createDataFrame([], schema).schema

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/articles")

    def run():
        incremental.embed_arriving(spark, f"{root}/articles", f"{root}/vectors", tokens, f"{root}/checkpoint", schema=fields,
                                   files_per_batch=1, order=["title"]).awaitTermination()
        return {r.news_id: r.embedding for r in spark.read.parquet(f"{root}/vectors").collect()}

    arrive([("a", "One", "two"), ("b", "two!", None), ("b", "one", None), (None, "one", None), ("", "one", None)])
    first = run()
    assert first == {"a": [0.5, 0.5], "b": [0.0, 1.0]}
    # A batch that breaks off is run again, and what it has written is replaced.
    arrive([("b", "one", None), ("c", "one", None)])
    whole = incremental.embed_batch

    def broken(batch, number, *rest):
        whole(batch, number, *rest)
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(incremental, "embed_batch", broken)
        with pytest.raises(Exception, match="lost"):
            run()
    assert run() == {**first, "c": [1.0, 0.0]}
    assert run() == {**first, "c": [1.0, 0.0]}
    assert spark.read.parquet(f"{root}/vectors").count() == 3
    with pytest.raises(ValueError, match="another checkpoint"):
        incremental.embed_arriving(spark, f"{root}/articles", f"{root}/vectors", tokens, f"{root}/other", schema=fields)


@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_a_batch_is_read_once_and_not_kept(spark, monkeypatch, budget):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    tokens = spark.createDataFrame([("one", [1.0, 0.0]), ("two", [0.0, 1.0])], "token string, vector array<float>")
    batch = spark.createDataFrame([(f"N{i}", "One", "two" if i % 2 else None) for i in range(30)], "news_id string, title string, abstract string")
    batch = batch.mapInArrow(counted, batch.schema)
    whole = incremental.document_vectors
    monkeypatch.setattr(incremental, "document_vectors", lambda *a: whole(*a, budget=budget))
    monkeypatch.setattr(type(batch), "persist", None)
    root = new_folder(spark, "batches")
    incremental.embed_batch(batch, 3, root, tokens)
    found = {r.news_id: r.embedding for r in spark.read.parquet(f"{root}/batch=3").collect()}
    assert read.value == 30 and found == {f"N{i}": [0.5, 0.5] if i % 2 else [1.0, 0.0] for i in range(30)}


def test_new_vectors_are_stored_packed_before_the_append(spark, monkeypatch):
    from newsweave.plans import content

    tokens = spark.createDataFrame([("one", [1.0, 0.0]), ("two", [0.0, 1.0])], "token string, vector array<float>")
    news = spark.createDataFrame([("a", "One", "two"), ("b", "two", None)], "news_id string, title string, abstract string")
    path = new_folder(spark, "vectors")
    monkeypatch.setattr(content, "cut_lineage", None)
    content.embed_new_articles([news.limit(1)], spark.createDataFrame([], "news_id string"), tokens, path)
    content.embed_new_articles([news], spark.read.parquet(path), tokens, path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", "0.5,0.5"), ("b", "0.0,1.0")]


def test_input_of_a_batch_does_not_grow(spark):
    root = new_folder(spark, "stream")
    tokens = spark.createDataFrame([("one", [1.0])], "token string, vector array<float>")
    schema = "news_id string, title string, abstract string"
    for n in range(6):
        spark.createDataFrame([(f"{n}-{i}", "one", None) for i in range(50)], schema).coalesce(1).write.mode("append").parquet(f"{root}/articles")
    query = incremental.embed_arriving(spark, f"{root}/articles", f"{root}/vectors", tokens, f"{root}/checkpoint",
                                       schema=spark.createDataFrame([], schema).schema, files_per_batch=1)
    query.awaitTermination()
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(read) == 6 and set(read) == {50}


@pytest.mark.parametrize("portion", [1 << 20, 1])
def test_best_items_equal_all_products(spark, portion):
    rng = np.random.default_rng(7)
    items = rng.normal(size=(300, 6)) * rng.pareto(1.5, size=(300, 1))
    items[7] = items[3]
    users = rng.normal(size=(40, 6))
    users[5] = 0
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)] + [(999, None)], "id int, features array<float>")
    found = {}
    visited = set()
    for r in inner_products.best_items(frame(users), frame(items), 5, block_items=16, portion_bytes=portion).collect():
        found.setdefault(r.user_id, []).append((r["rank"], r.news_id))
        visited.add((r.user_id, r.blocks))
    scores = users.astype("float32").astype(float) @ items.astype("float32").astype(float).T
    for user in range(40):
        order = sorted(range(300), key=lambda i: (-scores[user, i], i))[:5]
        assert [i for _, i in sorted(found[user])] == order
    blocks = dict(visited)
    assert blocks[5] == 19 and sum(b for u, b in visited if u != 5) / 39 < 10


def test_best_items_without_items_or_with_few(spark):
    kind = "id int, features array<float>"
    users = spark.createDataFrame([(1, [1.0, 0.0])], kind)
    assert inner_products.best_items(users, spark.createDataFrame([], kind)).count() == 0
    few = inner_products.best_items(users, spark.createDataFrame([(4, [2.0, 0.0]), (3, [2.0, 5.0])], kind)).collect()
    assert [(r.news_id, r["rank"]) for r in few] == [(3, 1), (4, 2)]


def test_compared_makes_the_truth_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    truth = spark.createDataFrame([("U1", "N1"), ("U2", None), ("U1", "N2")], "user_id string, news_id string")
    shown = spark.createDataFrame([("U1", "N1", 0.5, 1), ("U2", "N1", 0.25, 1), ("U3", "N2", 1.0, 1)], "user_id string, news_id string, similarity_score double, rank long")
    found = evaluation.compared({"a": shown, "b": shown}, truth.mapInArrow(counted, "user_id string, news_id string")).collect()
    assert [(r.recommender, r.users, r.mse) for r in sorted(found)] == [("a", 2, 0.15625), ("b", 2, 0.15625)]
    assert made.value == 3
