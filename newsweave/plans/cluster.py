"""The clustering job: article vectors to clusters and category counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from newsweave.constants import CLUSTER_PCA_COMPONENTS, CLUSTER_SEED, CLUSTER_STARTS, CLUSTERS
from newsweave.operators.clustering import (
    best_kmeans, category_counts, centred_pca, plane, with_category,
)
from newsweave.operators.similarity import fingerprint
from newsweave.operators.vectors import parsed_checked
from newsweave.sinks.versions import path_exists
from newsweave.sinks.writers import upsert, write_csv
from newsweave.sources.tables import ClusterInput


@dataclass(frozen=True)
class ClusterResult:
    clusters: DataFrame
    counts: DataFrame
    plane: DataFrame
    costs: list[float]


def reduced_articles(tables: ClusterInput, components: int, cache_root: str | None = None) -> DataFrame:
    """Vectors with category and principal components. With ``cache_root`` an
    earlier result for exactly the same input is read back."""
    vectors = tables.embeddings
    if "embedding_string" in vectors.columns:
        vectors = parsed_checked(vectors)
    if "_id" not in vectors.columns:
        vectors = vectors.withColumn("_id", F.col("news_id"))
    vectors = with_category(vectors.select("_id", "news_id", "embedding"), tables.news)
    if cache_root is None:
        return centred_pca(vectors, components)[0].drop("embedding")
    spark = vectors.sparkSession
    marked = vectors.withColumn("news_id", F.concat_ws("|", "_id", "news_id", "category"))
    folder = f"{cache_root}/{fingerprint(marked).replace(':', '_')}-{components}"
    if not path_exists(spark, f"{folder}/_SUCCESS"):
        centred_pca(vectors, components)[0].drop("embedding").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def cluster_job(
    tables: ClusterInput,
    components: int = CLUSTER_PCA_COMPONENTS,
    clusters: int = CLUSTERS,
    seed: int = CLUSTER_SEED,
    starts: int = CLUSTER_STARTS,
    cache_root: str | None = None,
    output_root: str | None = None,
    counts_path: str | None = None,
) -> ClusterResult:
    """Reduce, cluster, upsert the labels, and count categories per cluster."""
    reduced = reduced_articles(tables, components, cache_root)
    labelled, _, costs = best_kmeans(reduced, clusters, seed, starts)
    result = labelled.select("_id", "news_id", "category", F.col("cluster").cast("int").alias("cluster"), "pca_embedding")
    if output_root:
        result = upsert(result, output_root, "_id")
    counts = category_counts(result)
    if counts_path:
        write_csv(counts, counts_path)
    return ClusterResult(result, counts, plane(result), costs)
