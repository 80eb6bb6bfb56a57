"""Vectors, profiles, similarity search and nested recommendations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from newsweave.catalog import fixtures as fx
from newsweave.catalog.fixtures import (
    article_vectors, behaviors_train, clicked_pairs, content_profiles, content_recs,
    popular_recs, positions, rounded, rounded_sql, table,
)
from newsweave.catalog.registry import query
from newsweave.functions.vectors import cosine, unit_vector
from newsweave.operators.joins import lookup_join
from newsweave.operators import profiles, quantised, recommendations, similarity, vectors
from newsweave.session import cut_lineage, new_folder


def _embeddings(spark, folder):
    return table(spark, folder, "embeddings")


def _numbered_articles(spark, folder):
    return _embeddings(spark, folder).select(F.col("vec_id").alias("news_id"), "embedding")


@query("fn12_vector_text", f"""
select vec_id, pos, {rounded_sql('x')} "value"
from (select vec_id, unnest(embedding)::double x, unnest(range(1, len(embedding) + 1)) pos from embeddings)""")
def vector_text(spark, folder):
    # There and back, since the engines print floats differently.
    nested = _embeddings(spark, folder).select("vec_id", F.array("embedding").alias("embedding"))
    return positions(vectors.parsed(vectors.serialised(nested)), "vec_id", "embedding")


@query("fn13_parsed_vectors", f"""
with texts as (select vec_id, case when label = 3 then '0.1,zz,3' when label = 5 then '' when label = 6 then 'NaN,1,2'
                      when label = 7 then '1,Infinity,2' when label = 8 then null else vec_id || ',0.5,1.25' end t
               from embeddings),
parts as (select vec_id, list_transform(string_split(t, ','), lambda x: try_cast(x as float)) v from texts)
select vec_id, len(v)::bigint dimension, {rounded_sql('list_sum(list_transform(v, lambda x: x::double))')} total
from parts where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0""")
def parsed(spark, folder):
    texts = _embeddings(spark, folder).select(
        "vec_id",
        F.when(F.col("label") == 3, "0.1,zz,3").when(F.col("label") == 5, "").when(F.col("label") == 6, "NaN,1,2")
        .when(F.col("label") == 7, "1,Infinity,2").when(F.col("label") == 8, F.lit(None))
        .otherwise(F.concat("vec_id", F.lit(",0.5,1.25"))).alias("embedding_string"),
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors.parsed_checked(texts).select(
        "vec_id", F.size("embedding").cast("bigint").alias("dimension"), rounded(total).alias("total")
    )


@query("agg11_dimensions", """
select len(v)::bigint dimension, count(*) vectors
from (select embedding v from embeddings union all select embedding[1:32] from embeddings where label < 3) group by 1""")
def dimensions(spark, folder):
    whole = _embeddings(spark, folder)
    short = whole.filter("label < 3").select(F.slice("embedding", 1, 32).alias("embedding"))
    return vectors.dimensions(whole.select("embedding").unionByName(short))


@query("fn17_ml_vectors", f"""
select vec_id, pos, {rounded_sql('x')} "value"
from (select vec_id, unnest(embedding)::double x, unnest(range(1, len(embedding) + 1)) pos from embeddings)""")
def ml_vectors(spark, folder):
    there = vectors.to_ml_vector(_embeddings(spark, folder), "embedding", "vector")
    return positions(vectors.from_ml_vector(there, "vector", "back"), "vec_id", "back")


@query("fn18_normalised_vectors", f"""
with v as (select vec_id, embedding::double[] e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) n
           from embeddings)
select vec_id, pos, {rounded_sql('x / n')} "value"
from (select vec_id, n, unnest(e) x, unnest(range(1, len(e) + 1)) pos from v)""")
def normalised(spark, folder):
    return positions(vectors.normalised(_embeddings(spark, folder)), "vec_id", "embedding")


@query("jn2_history_left_join", f"""
select impression_id, h.user_id, h.news_id, {rounded_sql('a.embedding[1]')} first_value
from history_rows h left join (select * from article_vectors where category <> 'c3') a using (news_id)""")
def history_left(spark, folder):
    known = article_vectors(spark, folder).filter("category <> 'c3'")
    return profiles.history_vectors(behaviors_train(spark, folder), known).select(
        "impression_id", "user_id", "news_id", rounded(F.get("embedding", 0).cast("double")).alias("first_value")
    )


@query("jn3_history_inner_join", f"""
select impression_id, h.user_id, h.news_id, {rounded_sql('a.embedding[1]')} first_value
from history_rows h join (select * from article_vectors where category <> 'c3') a using (news_id)""")
def history_inner(spark, folder):
    known = article_vectors(spark, folder).filter("category <> 'c3'")
    return profiles.history_vectors(behaviors_train(spark, folder), known, "inner").select(
        "impression_id", "user_id", "news_id", rounded(F.get("embedding", 0).cast("double")).alias("first_value")
    )


_PROFILE = """
select user_id, pos, {value} "value" from (select user_id, unnest(p) x, unnest(range(1, len(p) + 1)) pos from {view})"""


@query("agg1_profiles_first_row", _PROFILE.format(value=rounded_sql("x"), view="first_profiles"))
def first_row(spark, folder):
    return positions(content_profiles(spark, folder), "user_id", "user_embedding")


@query("agg2_profiles_all_rows", _PROFILE.format(value=rounded_sql("x"), view="train_profiles"))
def all_rows(spark, folder):
    found = profiles.profiles_from_all_rows(behaviors_train(spark, folder), article_vectors(spark, folder))
    return positions(found, "user_id", "user_embedding")


@query("agg2_profiles_shuffled", _PROFILE.format(value=rounded_sql("x"), view="train_profiles"))
def all_rows_shuffled(spark, folder):
    # The path for vectors that are too many to broadcast.
    from newsweave.operators.behaviors import history_items

    pairs = history_items(behaviors_train(spark, folder))
    found = profiles.mean_vectors(pairs, article_vectors(spark, folder), budget=0)
    return positions(found, "user_id", "user_embedding")


@query("sim1_cosine_of_pairs", f"""
select event_id, {rounded_sql('list_cosine_similarity(a.embedding::double[], b.embedding::double[])')} similarity
from clicks c join embeddings a on c.k = a.vec_id join embeddings b on c.user_id % (select count(*) from embeddings) = b.vec_id""")
def cosine_pairs(spark, folder):
    left = _embeddings(spark, folder).select(F.col("vec_id").alias("k"), F.col("embedding").alias("a"))
    right = _embeddings(spark, folder).select(F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    pairs = fx.clicks(spark, folder).withColumn("other", F.col("user_id") % left.count())
    return lookup_join(lookup_join(pairs, left, "k"), right, "other").select(
        "event_id", rounded(cosine(F.col("a"), F.col("b"))).alias("similarity")
    )


_RECS = """select user_id, news_id, {score} similarity_score, "rank" from {view}"""
_EXACT = _RECS.format(score=rounded_sql("similarity_score"), view="nearest")


def _shown_recs(found):
    return found.withColumn("similarity_score", rounded(F.col("similarity_score")))


def _click_profiles(spark, folder):
    return profiles.mean_vectors(clicked_pairs(spark, folder), _numbered_articles(spark, folder))


@query("sim2_exact_by_cells", _EXACT)
def exact_by_cells(spark, folder):
    articles = _numbered_articles(spark, folder)
    index = similarity.build_cells(articles, cells=8)
    return _shown_recs(similarity.search_exact(_click_profiles(spark, folder), index))


@query("sim2_exact_by_blocks", _EXACT)
def exact_by_blocks(spark, folder):
    articles = _numbered_articles(spark, folder)
    return _shown_recs(similarity.top_articles(_click_profiles(spark, folder), articles, budget=0))


@query("sim5_small_blocks", _EXACT)
def small_blocks(spark, folder):
    index = similarity.build_cells(_numbered_articles(spark, folder), cells=4)
    return _shown_recs(similarity.search_exact(_click_profiles(spark, folder), index, block_rows=50))


@query("sim5_restartable_chunks", _EXACT)
def restartable_chunks(spark, folder):
    # The fingerprints and every chunk read the profiles.
    path, users, articles = new_folder(spark, "chunks"), cut_lineage(_click_profiles(spark, folder)), _numbered_articles(spark, folder)
    similarity.search_in_chunks(users, articles, path, 3)
    return _shown_recs(similarity.search_in_chunks(users, articles, path, 3))


@query("sim3_all_cells_probed", _EXACT)
def all_probed(spark, folder):
    index = similarity.build_cells(_numbered_articles(spark, folder), cells=8)
    return _shown_recs(similarity.search_approximate(_click_profiles(spark, folder), index, probes=8))


@query("sim3_approximate_top_k")
def approximate(spark, folder):
    index = similarity.build_cells(_numbered_articles(spark, folder), cells=20)
    return similarity.search_approximate(_click_profiles(spark, folder), index, probes=2)


_INDEXES: dict[tuple[str, str], str] = {}


def quantised_index(spark, folder):
    """The index of the test table, stored once per application."""
    path = _INDEXES.setdefault((spark.sparkContext.applicationId, folder), new_folder(spark, "quantised"))
    return quantised.load_or_build(_numbered_articles(spark, folder), path)


@query("sim3_quantised_top_k")
def quantised_top_k(spark, folder):
    index, users = quantised_index(spark, folder), cut_lineage(_click_profiles(spark, folder))
    probes = quantised.measured_probes(users, _numbered_articles(spark, folder), index)
    return quantised.search(users, index, probes=probes)


# All cells visited and all articles on the short list: then the result is exact.
@query("sim3_quantised_without_limits", _EXACT)
def quantised_without_limits(spark, folder):
    index = quantised_index(spark, folder)
    return _shown_recs(quantised.search(_click_profiles(spark, folder), index, probes=len(index.fine), short=10**6))


@query("sim4_quantised_recall", """
select count(distinct user_id) users, count(*) wanted, true recall_reached, true cells_follow_rows from nearest""")
def quantised_recall(spark, folder):
    articles, users = _numbered_articles(spark, folder), cut_lineage(_click_profiles(spark, folder))
    index = quantised_index(spark, folder)
    probes = quantised.measured_probes(users, articles, index)
    found = quantised.recall(quantised.search(users, index, probes=probes), similarity.top_articles(users, articles))
    wanted = articles.count() ** 0.5
    return found.select("users", "wanted", (F.col("recall") >= 0.9).alias("recall_reached"),
                        F.lit(wanted / 2 <= len(index.fine) <= wanted * 2).alias("cells_follow_rows"))


# With given centroids, here the mean directions of the labels, both the choice of
# cells and the search in them are exact.
@query("sim3_given_centroids", f"""
with unit as (
  select vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) e
  from embeddings),
centroids as (
  select label, list(m order by pos) c from (
    select label, pos, avg(x) m from (select label, unnest(e) x, unnest(range(1, len(e) + 1)) pos from unit) group by 1, 2) group by 1),
placed as (
  select vec_id, e, arg_max(centroids.label, list_cosine_similarity(e, c)) cell from unit, centroids group by 1, 2),
chosen as (
  select user_id, p, label from (
    select user_id, p, label, row_number() over (partition by user_id order by list_cosine_similarity(p, c) desc) r
    from click_profiles, centroids) where r <= 2)
select user_id, news_id, {rounded_sql('similarity_score')} similarity_score, "rank" from (
  select *, row_number() over (partition by user_id order by similarity_score desc, news_id) "rank" from (
    select user_id, vec_id news_id, round(list_cosine_similarity(p, e), 9) similarity_score
    from chosen join placed on label = cell)) where "rank" <= 10""")
def given_centroids(spark, folder):
    # One row per label.
    rows = _embeddings(spark, folder).select("label", F.posexplode(unit_vector(F.col("embedding"))).alias("pos", "x")).groupBy(
        "label", "pos").agg(F.avg("x").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
    centroids = np.array([[x["m"] for x in row["c"]] for row in rows.orderBy("label").collect()])
    index = similarity.cells_around(_numbered_articles(spark, folder), centroids)
    return _shown_recs(similarity.search_approximate(_click_profiles(spark, folder), index, probes=2))


@query("sim4_stored_cells", _EXACT)
def stored_cells(spark, folder):
    path = new_folder(spark, "cells")
    articles = _numbered_articles(spark, folder)
    similarity.load_or_build_cells(articles, path, cells=8)
    again = similarity.load_or_build_cells(articles, path, cells=8)
    return _shown_recs(similarity.search_exact(_click_profiles(spark, folder), again))


@query("win4_ranked_results", _RECS.format(score=rounded_sql("similarity_score"), view="popular_recs"))
def ranked(spark, folder):
    return _shown_recs(popular_recs(spark, folder))


@query("jn5_article_of_a_hit", f"""
select user_id, news_id, category, {rounded_sql('similarity_score')} similarity_score, "rank"
from content_recs join article_vectors using (news_id)""")
def article_of_hit(spark, folder):
    categories = article_vectors(spark, folder).select("news_id", "category")
    return lookup_join(_shown_recs(content_recs(spark, folder)), categories, "news_id")


@query("jn8_users_and_articles", _RECS.format(score=rounded_sql("similarity_score"), view="content_recs"))
def users_and_articles(spark, folder):
    return _shown_recs(content_recs(spark, folder))


_NESTED = """
select user_id "userId", string_agg(news_id || ':' || "rank", ' ' order by "rank") recommendations, count(*) n
from {view} group by 1"""


def _nested_text(nested):
    return nested.select(
        "userId",
        F.array_join(F.transform("recommendations", lambda r: F.concat(r["newsId"], F.lit(":"), r["rank"])), " ")
        .alias("recommendations"),
        F.size("recommendations").cast("bigint").alias("n"),
    )


@query("fn14_nested_recommendations", _NESTED.format(view="popular_recs"))
def nested(spark, folder):
    return _nested_text(recommendations.nested(popular_recs(spark, folder)))


@query("fn14_nested_from_arrays", _NESTED.format(view="popular_recs"))
def nested_from_arrays(spark, folder):
    rows = F.array_sort(F.collect_list(F.struct("rank", "news_id", "similarity_score")))
    arrays = popular_recs(spark, folder).groupBy("user_id").agg(rows.alias("r")).select(
        "user_id", F.col("r.news_id").alias("news_id"),
        F.col("r.similarity_score").alias("similarity_score"), F.col("r.rank").alias("rank"),
    )
    return _nested_text(recommendations.nested_from_arrays(arrays))


@query("fn15_un_nested_recommendations", """
select user_id "userId", news_id "newsId", similarity_score rating, "rank" from popular_recs""")
def un_nested(spark, folder):
    return recommendations.un_nested(recommendations.nested(popular_recs(spark, folder)))


@query("src7_recommended_ids", """
select user_id "userId", string_agg(news_id, ' ' order by "rank") news_ids from popular_recs group by 1""")
def recommended_ids(spark, folder):
    found = recommendations.recommended_ids(recommendations.nested(popular_recs(spark, folder)))
    return found.select("userId", F.array_join("news_ids", " ").alias("news_ids"))


@query("agg4_predictions_per_user", """
with scored as (select "userId", "newsId", count(*)::double prediction from items group by 1, 2)
select "userId", "newsId", prediction, row_number() over (partition by "userId" order by prediction desc, "newsId") "rank"
from scored""")
def predictions(spark, folder):
    from newsweave.operators.behaviors import interactions

    scored = interactions(behaviors_train(spark, folder)).groupBy("userId", "newsId").agg(
        F.count(F.lit(1)).cast("double").alias("prediction")
    )
    return recommendations.ranked_predictions(scored).select("userId", "newsId", "prediction", "rank")


@query("agg4_best_predictions_nested", """
with scored as (select "userId", "newsId", count(*)::double prediction from items group by 1, 2),
best as (select *, row_number() over (partition by "userId" order by prediction desc, "newsId") r from scored)
select "userId", string_agg("newsId", ' ' order by r) predictions from best where r <= 10 group by 1""")
def best_predictions(spark, folder):
    from newsweave.operators.behaviors import interactions

    scored = interactions(behaviors_train(spark, folder)).groupBy("userId", "newsId").agg(
        F.count(F.lit(1)).cast("double").alias("prediction")
    )
    found = recommendations.predictions_per_user(scored, 10)
    return found.select("userId", F.array_join(F.col("predictions.newsId"), " ").alias("predictions"))


@query("fn19_renamed_results", """
select user_id "userId", news_id, ("rank")::integer "rank" from popular_recs""")
def renamed(spark, folder):
    found = popular_recs(spark, folder).select("user_id", "news_id", F.col("rank").cast("int").alias("rank"))
    return found.withColumnRenamed("user_id", "userId")
