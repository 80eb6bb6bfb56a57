"""Profiles from clicks and the ten nearest articles of every user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsweave.catalog.fixtures import clicked_pairs, rounded, rounded_sql, table
from newsweave.catalog.registry import query
from newsweave.operators.profiles import mean_vectors
from newsweave.operators.similarity import top_articles


@query("nearest_articles_per_user", f"""
select user_id, news_id, {rounded_sql('similarity_score')} similarity_score, "rank" from nearest""")
def nearest_articles(spark: SparkSession, folder: str) -> DataFrame:
    articles = table(spark, folder, "embeddings").select(F.col("vec_id").alias("news_id"), "embedding")
    found = top_articles(mean_vectors(clicked_pairs(spark, folder), articles), articles)
    return found.withColumn("similarity_score", rounded(F.col("similarity_score")))
