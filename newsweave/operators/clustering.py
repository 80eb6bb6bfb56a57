"""Dimension reduction and clustering of article vectors."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from newsweave.constants import (
    CLUSTER_PCA_COMPONENTS, CLUSTER_SEED, CLUSTER_STARTS, CLUSTERS, CONTENT_PCA_COMPONENTS,
    UNKNOWN_CATEGORY,
)
from newsweave.operators.joins import lookup_join

# Starts of a clustering that run at the same time.
PARALLEL_STARTS = 4


def with_category(vectors: DataFrame, news: DataFrame) -> DataFrame:
    """Vectors with the article's category; ``unknown`` for an article that is
    missing from ``news`` or has none. Articles in ``news`` are unique."""
    categories = news.filter(F.col("news_id").isNotNull()).select("news_id", "category")
    return lookup_join(vectors, categories, "news_id", "left").withColumn(
        "category", F.coalesce("category", F.lit(UNKNOWN_CATEGORY))
    )


def centred_pca(
    vectors: DataFrame, components: int = CLUSTER_PCA_COMPONENTS, column: str = "embedding", out: str = "pca_embedding"
) -> tuple[DataFrame, PipelineModel]:
    """Vectors projected on their principal components after centring."""
    prepared = vectors.withColumn("_vector", array_to_vector(F.col(column).cast("array<double>")))
    model = Pipeline(stages=[
        StandardScaler(inputCol="_vector", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=components, inputCol="_centred", outputCol="_reduced"),
    ]).fit(prepared)
    reduced = model.transform(prepared).withColumn(out, vector_to_array("_reduced"))
    return reduced.drop("_vector", "_centred", "_reduced"), model


def plain_pca(
    vectors: DataFrame, components: int = CONTENT_PCA_COMPONENTS, column: str = "embedding", out: str = "embedding_pca"
) -> tuple[DataFrame, PCAModel]:
    """Vectors projected on their principal components without centring, as
    used before the search: news_id and the reduced vector."""
    prepared = vectors.select("news_id", array_to_vector(F.col(column).cast("array<double>")).alias("_vector"))
    model = PCA(k=components, inputCol="_vector", outputCol="_reduced").fit(prepared)
    return model.transform(prepared).select("news_id", vector_to_array("_reduced").alias(out)), model


def best_kmeans(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    seed: int = CLUSTER_SEED,
    starts: int = CLUSTER_STARTS,
    column: str = "pca_embedding",
) -> tuple[DataFrame, KMeansModel, list[float]]:
    """Cluster labels from the start with the lowest cost, its model, and the
    costs of all starts. The starts are submitted together, up to PARALLEL_STARTS."""
    features = vectors.select(array_to_vector(column).alias("features")).persist()
    # Filled once, before the starts ask for it at the same time.
    features.count()

    def fit(start: int) -> KMeansModel:
        return KMeans(k=clusters, seed=seed + start, featuresCol="features").fit(features)

    with ThreadPool(max(min(starts, PARALLEL_STARTS), 1)) as pool:
        models = pool.map(inheritable_thread_target(vectors.sparkSession)(fit), range(starts))
    costs = [model.summary.trainingCost for model in models]
    best = models[costs.index(min(costs))]
    features.unpersist()
    labelled = best.setPredictionCol("cluster").transform(
        vectors.withColumn("features", array_to_vector(column))
    ).drop("features")
    return labelled, best, costs


def category_counts(clusters: DataFrame) -> DataFrame:
    """Articles per cluster and category; rows lacking either are dropped."""
    known = clusters.na.drop(subset=["category", "cluster"])
    return known.groupBy(F.col("cluster").cast("int").alias("cluster"), "category").agg(
        F.count(F.lit(1)).alias("count")
    )


def category_table(counts: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Counts with one column per category, 0 where a cluster has none. Without
    ``categories`` their names are read first, up to Spark's pivot limit."""
    pivot = counts.groupBy("cluster").pivot("category", categories).agg(F.sum("count"))
    return pivot.na.fill(0)


def plane(clusters: DataFrame, column: str = "pca_embedding") -> DataFrame:
    """The first two components of each article, for a plot of the clusters."""
    return clusters.select(
        "news_id", F.get(column, 0).alias("x"), F.get(column, 1).alias("y"), "cluster"
    )
