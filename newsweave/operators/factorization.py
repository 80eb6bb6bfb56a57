"""Implicit-feedback matrix factorisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsweave.constants import (
    ALS_PARAMS, GRID_ALPHAS, GRID_FOLDS, GRID_PARALLELISM, GRID_RANKS, GRID_REG_PARAMS, TOP_K,
)
from newsweave.operators.inner_products import best_items
from newsweave.session import shared_folder
from newsweave.operators.evaluation import (
    mean_ranking_metrics, ranking_metrics, regression_metrics,
)


def als_estimator(seed: int = 47, **params) -> ALS:
    """The factor model to fit; ``params`` override the defaults. The rank has to
    stay below the numbers of users and of items, or the solver may fail. Factors
    are held in as many blocks as there are cores, and cut from their lineage in
    the shared folder every ten iterations."""
    spark = SparkSession.active()
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    blocks = max(10, context.defaultParallelism)
    return ALS(
        userCol="userId", itemCol="newsId", ratingCol="clicked", implicitPrefs=True,
        coldStartStrategy="drop", seed=seed, **{"numUserBlocks": blocks, "numItemBlocks": blocks, **ALS_PARAMS, **params},
    )


def predictions(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """Scores of (user, item) pairs; pairs with an unseen id are dropped."""
    return model.transform(pairs)


def recommendations(model: ALSModel, k: int = TOP_K) -> DataFrame:
    """The ``k`` best items of every user, nested."""
    return model.recommendForAllUsers(k)


def flat_recommendations(nested: DataFrame) -> DataFrame:
    """Nested recommendations as rows user_id, news_id, similarity_score, rank."""
    return nested.select("userId", F.posexplode("recommendations").alias("place", "entry")).select(
        F.col("userId").alias("user_id"),
        F.col("entry.newsId").alias("news_id"),
        F.col("entry.rating").cast("double").alias("similarity_score"),
        (F.col("place") + 1).cast("bigint").alias("rank"),
    )


def best_of_users(model: ALSModel, k: int = TOP_K) -> DataFrame:
    """The same as rows user_id, news_id, similarity_score, rank, without a product of
    all users and items: see :func:`best_items`. Ties go to the lower id. ``blocks``
    tells how many blocks of items a user was compared with."""
    return best_items(model.userFactors, model.itemFactors, k)


def save_model(model: ALSModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> ALSModel:
    """A saved model. A missing one is an error."""
    return ALSModel.load(path)


def convergence(
    train: DataFrame, valid: DataFrame, iterations: int = ALS_PARAMS["maxIter"], seed: int = 47, **params
) -> tuple[DataFrame, ALSModel]:
    """Validation error after 1, 2, ... ``iterations`` iterations, and the last
    model. The samples are computed once; one metric row per fit reaches the
    driver."""
    spark = train.sparkSession
    train, valid = train.persist(), valid.persist()
    curve, model = [], None
    for iteration in range(1, iterations + 1):
        model = als_estimator(seed, **{**params, "maxIter": iteration}).fit(train)
        row = regression_metrics(predictions(model, valid)).first()
        curve.append((iteration, row["rmse"], row["mae"]))
    train.unpersist()
    valid.unpersist()
    return spark.createDataFrame(curve, "iteration int, rmse double, mae double"), model


def with_fold(rows: DataFrame, folds: int, seed: int) -> DataFrame:
    """``rows`` with the number of the fold each is held out in."""
    return rows.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(folds)).cast("int"))


def grid_search(
    train: DataFrame,
    ranks: Sequence[int] = GRID_RANKS,
    reg_params: Sequence[float] = GRID_REG_PARAMS,
    alphas: Sequence[float] = GRID_ALPHAS,
    folds: int = GRID_FOLDS,
    parallelism: int = GRID_PARALLELISM,
    seed: int = 47,
    **params,
) -> tuple[DataFrame, CrossValidatorModel]:
    """Cross-validated error of every parameter combination, best first, and
    the fitted search. Feedback is implicit here too, so alpha has an effect. A row's
    fold follows from its values (:func:`with_fold`), so the errors can be checked."""
    als = als_estimator(seed, **params)
    grid = (
        ParamGridBuilder().addGrid(als.rank, list(ranks)).addGrid(als.regParam, list(reg_params))
        .addGrid(als.alpha, list(alphas)).build()
    )
    search = CrossValidator(
        estimator=als, estimatorParamMaps=grid, numFolds=folds, parallelism=parallelism, seed=seed, foldCol="_fold",
        evaluator=RegressionEvaluator(metricName="rmse", labelCol="clicked", predictionCol="prediction"),
    )
    train = with_fold(train, folds, seed).persist()
    found = search.fit(train)
    train.unpersist()
    rows = [
        (int(point[als.rank]), float(point[als.regParam]), float(point[als.alpha]), float(error))
        for point, error in zip(grid, found.avgMetrics)
    ]
    rows.sort(key=lambda row: row[3])
    table = train.sparkSession.createDataFrame(rows, "rank int, reg_param double, alpha double, rmse double")
    return table, found


def evaluated(spark: SparkSession, path: str, pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """Ranking metrics of a saved model against (user_id, news_id) pairs with
    the model's int ids."""
    flat = best_of_users(load_model(path), k)
    return mean_ranking_metrics(ranking_metrics(flat, pairs, k))
