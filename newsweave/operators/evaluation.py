"""Quality of predictions and recommendations, as tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from newsweave.constants import TOP_K
from newsweave.operators.recommendations import of_known_users, with_label
from newsweave.session import cut_lineage


def regression_metrics(predictions: DataFrame, label: str = "clicked", prediction: str = "prediction") -> DataFrame:
    """Root mean squared error and mean absolute error, in one row."""
    error = F.col(label).cast("double") - F.col(prediction).cast("double")
    return predictions.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae")
    )


def similarity_errors(recommendations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Squared error of the similarity against the clicked label, over the
    recommendations of users that occur in the truth."""
    labelled = with_label(of_known_users(recommendations, pairs), pairs.na.drop(subset=["news_id"]))
    error = F.col("label") - F.col("similarity_score")
    return labelled.agg(F.avg(error * error).alias("mse")).withColumn("rmse", F.sqrt("mse"))


def ranking_metrics(recommendations: DataFrame, pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """Precision, recall, NDCG and average precision at ``k`` for every user
    with recommendations and a row in the truth (``pairs``, where a null item
    stands for a user without clicks: all metrics are then 0)."""
    shown = recommendations.filter(F.col("rank") <= k).select("user_id", "news_id", "rank")
    truth = pairs.groupBy("user_id").agg(F.count_distinct("news_id").alias("relevant"))
    hits = with_label(shown, pairs).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("label") == 1, F.col("rank")))).alias("ranks")
    )
    # Best possible gain for 1 to k relevant items.
    ideal, total = [], 0.0
    for place in range(1, k + 1):
        total += 1 / math.log2(place + 1)
        ideal.append(F.lit(total))
    gain = F.aggregate("ranks", F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + F.lit(1.0)))
    precisions = F.aggregate(
        F.transform("ranks", lambda r, i: (i + 1) / r), F.lit(0.0), lambda s, x: s + x
    )
    any_hit = F.size("ranks") > 0
    best = F.element_at(F.array(*ideal), F.least(F.col("relevant"), F.lit(k)).cast("int"))
    return hits.join(truth, "user_id").select(
        "user_id",
        (F.size("ranks") / F.lit(float(k))).alias("precision"),
        F.when(any_hit, F.size("ranks") / F.col("relevant")).otherwise(0.0).alias("recall"),
        F.when(any_hit, gain / best).otherwise(0.0).alias("ndcg"),
        F.when(any_hit, precisions / F.col("relevant")).otherwise(0.0).alias("average_precision"),
    )


def mean_ranking_metrics(per_user: DataFrame) -> DataFrame:
    """The means over users, in one row."""
    return per_user.agg(
        F.count(F.lit(1)).alias("users"),
        F.avg("precision").alias("precision_at_k"),
        F.avg("recall").alias("recall_at_k"),
        F.avg("ndcg").alias("ndcg_at_k"),
        F.avg("average_precision").alias("mean_average_precision"),
    )


def compared(recommenders: dict[str, DataFrame], pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """Ranking metrics and similarity errors of several recommenders side by
    side, one row each. All tables use the same kind of ids."""
    rows, pairs = None, cut_lineage(pairs)
    for name, flat in recommenders.items():
        # Two metrics read it, and it may be a whole search.
        flat = cut_lineage(flat)
        ranking = mean_ranking_metrics(ranking_metrics(flat, pairs, k))
        errors = similarity_errors(flat, pairs)
        row = ranking.withColumn("recommender", F.lit(name)).join(
            errors.withColumn("recommender", F.lit(name)), "recommender"
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows
