"""User profiles: the mean vector of the articles a user has read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from newsweave.operators.behaviors import first_behaviors, history_items
from newsweave.operators.joins import BROADCAST_BYTES, bucketed, lookup_join, table_bytes

# Bytes of the vectors that the counts of a bucket may ask for.
BUCKET_BYTES = 64 << 20


def history_vectors(behaviors: DataFrame, embeddings: DataFrame, how: str = "left") -> DataFrame:
    """History items with their vector, null where there is none for ``left``."""
    return lookup_join(history_items(behaviors), embeddings.select("news_id", "embedding"), "news_id", how)


def mean_vectors(
    pairs: DataFrame,
    vectors: DataFrame,
    group: str = "user_id",
    item: str = "news_id",
    vector: str = "embedding",
    out: str = "user_embedding",
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """Mean vector per group over its items, an item counting once per row.
    Items without a vector are ignored, groups without any are dropped.

    The repeats of an item are counted first. While the vectors can be broadcast,
    the counts are shuffled by group and meet the vectors there, so that no vector
    is shuffled; a group holds an item once, so there are no more rows of it than
    vectors. Beyond that groups are dealt into buckets, each of which gets the vectors
    it needs once (:func:`bucketed`); a task adds up a bucket.
    """
    table = vectors.filter(F.col(vector).isNotNull()).select(
        F.col(item), array_to_vector(F.col(vector).cast("array<double>")).alias("_vector")
    )
    weights = pairs.groupBy(group, item).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    if table_bytes(vectors.select(item, vector)) <= budget:
        joined = weights.repartition(group).join(F.broadcast(table), item)
    else:
        joined = _bucket_means(weights, _numbers(vectors, item, vector), group, item)
    return _weighted_means(joined, group, out)


def _weighted_means(parts: DataFrame, group: str, out: str) -> DataFrame:
    """The mean per group of ``parts`` (group, _vector, _weight)."""
    summary = Summarizer.metrics("mean").summary(F.col("_vector"), F.col("_weight"))
    return parts.groupBy(group).agg(summary.alias("_summary")).select(
        group, vector_to_array("_summary.mean").alias(out)
    )


def _numbers(vectors: DataFrame, item: str, vector: str) -> DataFrame:
    """(item, _vector) of the vectors that are there, floats as such, as they take half the room."""
    narrow = vectors.schema[vector].dataType == T.ArrayType(T.FloatType())
    return vectors.filter(F.col(vector).isNotNull()).select(
        F.col(item), (F.col(vector) if narrow else F.col(vector).cast("array<double>")).alias("_vector"))


def _bucket_means(weights: DataFrame, vectors: DataFrame, group: str, item: str) -> DataFrame:
    """(group, _vector, _weight): weighted means of the items of ``weights`` (group,
    item, _weight), one for each group and bucket that has items with a vector."""
    first = vectors.first()
    dimension = max(len(first["_vector"]), 1) if first else 1
    dealt, needed = bucketed(weights, group, item, vectors, max(BUCKET_BYTES // (8 * dimension), 1))
    dealt = dealt.select("_bucket", F.col(group).alias("group"), F.col(item).alias("item"), "_weight")
    needed = needed.select("_of_bucket", F.col(item).alias("item"), "_vector")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"group": left["group"].slice(0, 0), "_vector": pa.array([], pa.list_(pa.float64())), "_weight": pa.array([], pa.float64())})
        flat = np.asarray(pc.list_flatten(right["_vector"].combine_chunks()), np.float64)
        sizes = np.unique(pc.list_value_length(right["_vector"]).to_numpy())
        if len(sizes) > 1:
            raise ValueError(f"vectors need one dimension, found {sizes[0]} to {sizes[-1]}")
        table = flat.reshape(right.num_rows, -1)
        # An item may have several vectors, each of which counts.
        names = pc.unique(right["item"].combine_chunks())
        place = pc.index_in(right["item"], names).to_numpy()
        sums, copies = np.zeros((len(names), table.shape[1])), np.bincount(place, minlength=len(names))
        np.add.at(sums, place, table)
        at = pc.index_in(left["item"], names)
        left, at = left.filter(pc.is_valid(at)), pc.drop_null(at).to_numpy()
        groups = left["group"].combine_chunks().dictionary_encode("encode")
        owner, weight = groups.indices.to_numpy(), left["_weight"].to_numpy()
        order = np.argsort(owner, kind="stable")
        means, total = np.zeros((len(groups.dictionary), table.shape[1])), np.bincount(owner, weight * copies[at], len(groups.dictionary))
        for start in range(0, len(order), 4096):
            part = order[start : start + 4096]
            heads = np.flatnonzero(np.append(True, owner[part][1:] != owner[part][:-1]))
            means[owner[part][heads]] += np.add.reduceat(sums[at[part]] * weight[part, None], heads, axis=0)
        means /= total[:, None]
        ends = np.arange(len(means) + 1, dtype=np.int32) * table.shape[1]
        return pa.table({"group": groups.dictionary, "_vector": pa.ListArray.from_arrays(pa.array(ends), pa.array(means.reshape(-1))), "_weight": total})

    kind = weights.schema[group].dataType.simpleString()
    found = dealt.groupBy("_bucket").cogroup(needed.groupBy("_of_bucket")).applyInArrow(
        add, f"group {kind}, _vector array<double>, _weight double")
    return found.select(F.col("group").alias(group), array_to_vector("_vector").alias("_vector"), "_weight")


def profiles_from_first_row(behaviors: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Profiles from the history of each user's first row in the click log."""
    return mean_vectors(history_items(first_behaviors(behaviors)), embeddings)


def profiles_from_all_rows(behaviors: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Profiles from the histories of all of a user's rows."""
    return mean_vectors(history_items(behaviors), embeddings)
