"""From click logs to interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsweave.constants import NPRATIO, SPLIT_RATIO, SPLIT_SEED
from newsweave.functions.clicks import (
    click_label, hash_fraction, numeric_id, repeatable_key, shown_item, words,
)
from newsweave.operators.ranking import default_pieces, hash_piece, row_numbers, top_k


def renamed_behaviors(behaviors: DataFrame) -> DataFrame:
    """The click log under the names the factor model uses."""
    return behaviors.select(
        F.col("impression_id").alias("impressionId"),
        F.col("user_id").alias("userId"),
        F.col("time").alias("timestamp"),
        F.col("history").alias("clicked"),
        "impressions",
    )


def shown_items(behaviors: DataFrame) -> DataFrame:
    """One row per item shown, with its place in the impression list. Rows
    without an impression list give none.

    The outer form and the filter after it keep Spark from splitting the list a
    second time just to see whether it is empty.
    """
    return behaviors.select(
        "impression_id", "user_id",
        F.posexplode_outer(F.split("impressions", " ")).alias("position", "impression"),
    ).filter(F.col("position").isNotNull())


def labelled_items(shown: DataFrame) -> DataFrame:
    """The item id and the click label of every shown item."""
    return shown.withColumn("news_id", shown_item(F.col("impression"))).withColumn(
        "clicked", click_label(F.col("impression"))
    )


def numbered_ids(labelled: DataFrame) -> DataFrame:
    """Ids as ints under the names the factor model uses; bad ids become null."""
    return labelled.withColumn("userId", numeric_id(F.col("user_id"), "U")).withColumn(
        "newsId", numeric_id(F.col("news_id"), "N")
    )


def with_values(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of ``columns`` is null."""
    return df.na.drop(subset=list(columns))


def interactions(behaviors: DataFrame) -> DataFrame:
    """Shown items with int ids and label; rows with a bad id are dropped."""
    return with_values(
        numbered_ids(labelled_items(shown_items(behaviors))), "userId", "newsId", "clicked"
    ).select("userId", "newsId", "clicked", "impression_id", "position")


def positives(items: DataFrame) -> DataFrame:
    return items.filter(F.col("clicked") == 1)


def negatives(items: DataFrame) -> DataFrame:
    return items.filter(F.col("clicked") == 0)


def sample_key(seed: int = SPLIT_SEED) -> Column:
    """The sort key of negative sampling: it covers the row's place in the log,
    since one item may be shown to a user more than once."""
    return repeatable_key(seed, *[F.col(c) for c in ("userId", "newsId", "impression_id", "position")])


def sampled_negatives(
    items: DataFrame, npratio: int = NPRATIO, seed: int = SPLIT_SEED, per_positive: bool = False
) -> DataFrame:
    """At most ``npratio`` items shown but not clicked, per user in total or,
    with ``per_positive``, for each of the user's clicks."""
    keyed = negatives(items).withColumn("_key", sample_key(seed))
    if not per_positive:
        chosen = top_k(keyed, "userId", [F.col("_key"), F.col("impression_id"), F.col("position")], npratio)
        return chosen.drop("_key", "rank")
    quota = positives(items).groupBy(F.col("userId").alias("_user")).agg(
        (F.count(F.lit(1)) * npratio).alias("_quota")
    )
    # The key is uniform, so a user's rows fall evenly into the ranges of it.
    pieces = default_pieces(items)
    ranked = row_numbers(
        keyed, ["_key", "impression_id", "position"], ["userId"], "_rank", pieces, hash_piece(F.col("_key"), pieces)
    )
    return (
        ranked.join(quota, F.col("userId") == F.col("_user"))
        .filter(F.col("_rank") <= F.col("_quota")).select(*items.columns)
    )


def training_sample(
    behaviors: DataFrame, npratio: int = NPRATIO, seed: int = SPLIT_SEED, per_positive: bool = False
) -> DataFrame:
    """All clicks and the sampled non-clicks of one click log."""
    items = interactions(behaviors)
    chosen = sampled_negatives(items, npratio, seed, per_positive)
    return positives(items).unionByName(chosen).select("userId", "newsId", "clicked")


def training_samples(
    train: DataFrame, valid: DataFrame, npratio: int = NPRATIO, seed: int = SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """:func:`training_sample` of the training and of the validation log."""
    return training_sample(train, npratio, seed), training_sample(valid, npratio, seed)


def repeatable_split(
    df: DataFrame, keys: list[str], ratio: float = SPLIT_RATIO, seed: int = SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, decided by a hash of ``keys``."""
    fraction = hash_fraction(repeatable_key(seed, *[F.col(k) for k in keys]))
    return df.filter(fraction < ratio), df.filter(fraction >= ratio)


def history_items(behaviors: DataFrame) -> DataFrame:
    """One row per item in the reading history, repeats kept."""
    return behaviors.select(
        "impression_id", "user_id", F.explode_outer(words(F.col("history"))).alias("news_id")
    ).filter(F.col("news_id").isNotNull())


def first_behaviors(behaviors: DataFrame) -> DataFrame:
    """Each user's row with the lowest impression id; a null history is empty."""
    first = F.min_by(F.coalesce("history", F.lit("")), "impression_id")
    return behaviors.groupBy("user_id").agg(
        F.min("impression_id").alias("impression_id"), first.alias("history")
    )


def truth_pairs(behaviors: DataFrame) -> DataFrame:
    """The distinct items each user clicked, with string ids as in the log. A
    null item stands for items not clicked, so every user has a row."""
    shown = behaviors.select("user_id", F.explode_outer(words(F.col("impressions"))).alias("impression"))
    clicked = F.when(F.col("impression").endswith("-1"), shown_item(F.col("impression")))
    return shown.select("user_id", clicked.alias("news_id")).distinct()


def ground_truth(behaviors: DataFrame) -> DataFrame:
    """The sorted set of items each user clicked, empty for users without one."""
    return truth_pairs(behaviors).groupBy("user_id").agg(
        F.array_sort(F.collect_list("news_id")).alias("relevant")
    )

