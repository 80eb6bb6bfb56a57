"""Recommendation tables: nesting, un-nesting and matching with the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsweave.functions.clicks import numeric_id
from newsweave.operators.ranking import row_numbers, top_k


def nested(flat: DataFrame) -> DataFrame:
    """Flat rows (user_id, news_id, similarity_score, rank) as one row per user
    with the recommendations in rank order."""
    entry = F.struct(
        F.col("rank"), F.col("news_id").alias("newsId"), F.col("similarity_score").alias("rating")
    )
    return flat.groupBy(F.col("user_id").alias("userId")).agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda x: F.struct(x["newsId"].alias("newsId"), x["rating"].alias("rating"), x["rank"].alias("rank")),
        ).alias("recommendations")
    )


def nested_from_arrays(arrays: DataFrame) -> DataFrame:
    """The same from parallel arrays news_id, similarity_score and rank."""
    return arrays.select(
        F.col("user_id").alias("userId"),
        F.transform(
            F.arrays_zip("news_id", "similarity_score", "rank"),
            lambda x: F.struct(
                x["news_id"].alias("newsId"), x["similarity_score"].alias("rating"), x["rank"].alias("rank")
            ),
        ).alias("recommendations"),
    )


def un_nested(recommendations: DataFrame) -> DataFrame:
    """One row per recommendation: userId and the fields of the entry."""
    return recommendations.select("userId", F.inline("recommendations"))


def recommended_ids(recommendations: DataFrame) -> DataFrame:
    """Each user's recommended ids in order."""
    return recommendations.select(
        "userId", F.transform("recommendations", lambda r: r["newsId"]).alias("news_ids")
    )


def ranked_predictions(predictions: DataFrame) -> DataFrame:
    """Every prediction of every user with its rank from 1, best first, ties by
    item. The ranking stays in rows, as one user's may not fit into one of them."""
    keyed = predictions.withColumn("_low", -F.col("prediction"))
    return row_numbers(keyed, ["_low", "newsId"], ["userId"], out="rank").drop("_low")


def predictions_per_user(predictions: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (prediction, newsId) pairs of each user as one row, best
    first, ties by item. ``k`` bounds the row."""
    best = top_k(predictions, "userId", [F.desc("prediction"), F.col("newsId")], k)
    return best.groupBy("userId").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "prediction", "newsId"))),
            lambda p: F.struct(p["prediction"].alias("prediction"), p["newsId"].alias("newsId")),
        ).alias("predictions")
    )


def common_users(left: DataFrame, right: DataFrame, user: str = "user_id") -> DataFrame:
    """Users present in both tables."""
    return left.select(user).intersect(right.select(user))


def of_known_users(recommendations: DataFrame, truth: DataFrame, user: str = "user_id") -> DataFrame:
    """Recommendations of users that also have a row in ``truth``."""
    return recommendations.join(truth.select(user), user, "left_semi")


def with_label(recommendations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Label 1 where the user clicked the recommended item, else 0."""
    hits = pairs.select("user_id", "news_id").distinct().withColumn("_hit", F.lit(1))
    return (
        recommendations.join(hits, ["user_id", "news_id"], "left")
        .withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")
    )


def factor_ids(flat: DataFrame, keep_empty: bool = False) -> DataFrame:
    """String ids replaced by the int ids of the factor model; rows whose ids
    have no such form are dropped. ``keep_empty`` keeps rows whose item was
    null before."""
    item = numeric_id(F.col("news_id"), "N")
    kept = flat.filter(item.isNotNull() | F.col("news_id").isNull()) if keep_empty else flat.filter(item.isNotNull())
    return (
        kept.withColumn("news_id", item).withColumn("user_id", numeric_id(F.col("user_id"), "U"))
        .na.drop(subset=["user_id"])
    )
