"""Metrics, labels and user sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.catalog.fixtures import (
    behaviors_train, behaviors_valid, content_recs, popular_recs, rounded, rounded_sql, table,
)
from newsweave.catalog.registry import VIEWS, query
from newsweave.operators import evaluation, recommendations
from newsweave.operators.behaviors import interactions, training_samples, truth_pairs
from newsweave.operators.factorization import als_estimator, flat_recommendations, recommendations as als_recommendations

VIEWS["known_recs"] = "select r.* from {} r where user_id in (select user_id from truth)".format("popular_recs")
VIEWS["ranked_hits"] = """
select r.user_id, r."rank" k, t.news_id is not null hit
from known_recs r left join (select distinct * from truth where news_id is not null) t
  on t.user_id = r.user_id and t.news_id = r.news_id"""
VIEWS["user_metrics"] = """
with hits as (
  select user_id, k, row_number() over (partition by user_id order by k) n from ranked_hits where hit),
sums as (
  select user_id, count(*) h, sum(1 / log2(k + 1)) gain, sum(n / k) precisions from hits group by 1),
sizes as (select user_id, count(news_id) t from truth group by 1),
ideal as (select n, sum(1 / log2(n + 1)) over (order by n) best from range(1, 11) r(n))
select u.user_id, coalesce(h, 0) / 10.0::double "precision", coalesce(h / t::double, 0) recall,
       coalesce(gain / best, 0) ndcg, coalesce(precisions / t, 0) average_precision
from (select distinct user_id from known_recs) u join sizes using (user_id) left join sums using (user_id)
left join ideal on n = least(t, 10)"""


def _truth(spark, folder):
    return truth_pairs(behaviors_valid(spark, folder))


@query("ev1_regression_metrics", f"""
with p as (select clicked::double clicked, ("newsId" % 10) / 10.0::double prediction from items)
select {rounded_sql('sqrt(avg((clicked - prediction) * (clicked - prediction)))')} rmse,
       {rounded_sql('avg(abs(clicked - prediction))')} mae from p""")
def regression(spark, folder):
    scored = interactions(behaviors_train(spark, folder)).withColumn(
        "prediction", (F.col("newsId") % 10) / F.lit(10.0)
    )
    found = evaluation.regression_metrics(scored)
    return found.select(rounded(F.col("rmse")).alias("rmse"), rounded(F.col("mae")).alias("mae"))


_ERRORS = """
with l as (
  select similarity_score s, case when (r.user_id, r.news_id) in (select user_id, news_id from truth where news_id is not null)
         then 1 else 0 end label
  from {view} r where user_id in (select user_id from truth))
select {mse} mse, {rmse} rmse from l"""


@query("ev2_similarity_errors", _ERRORS.format(
    view="content_recs", mse=rounded_sql("avg((label - s) * (label - s))"),
    rmse=rounded_sql("sqrt(avg((label - s) * (label - s)))"),
))
def similarity_errors(spark, folder):
    found = evaluation.similarity_errors(content_recs(spark, folder), _truth(spark, folder))
    return found.select(rounded(F.col("mse")).alias("mse"), rounded(F.col("rmse")).alias("rmse"))


@query("ev3_ranking_metrics_per_user", f"""
select user_id, {rounded_sql('"precision"')} "precision", {rounded_sql('recall')} recall,
       {rounded_sql('ndcg')} ndcg, {rounded_sql('average_precision')} average_precision from user_metrics""")
def ranking_per_user(spark, folder):
    found = evaluation.ranking_metrics(popular_recs(spark, folder), _truth(spark, folder))
    return found.select("user_id", *[
        rounded(F.col(c)).alias(c) for c in ("precision", "recall", "ndcg", "average_precision")
    ])


@query("ev3_mean_ranking_metrics", f"""
select count(*) users, {rounded_sql('avg("precision")')} precision_at_k, {rounded_sql('avg(recall)')} recall_at_k,
       {rounded_sql('avg(ndcg)')} ndcg_at_k, {rounded_sql('avg(average_precision)')} mean_average_precision
from user_metrics""")
def ranking_means(spark, folder):
    found = evaluation.mean_ranking_metrics(
        evaluation.ranking_metrics(popular_recs(spark, folder), _truth(spark, folder))
    )
    return found.select("users", *[rounded(F.col(c)).alias(c) for c in found.columns[1:]])


@query("ev5_compared_recommenders")
def compared(spark, folder):
    train, valid = behaviors_train(spark, folder), behaviors_valid(spark, folder)
    sample, _ = training_samples(train, valid)
    model = als_estimator(rank=10, maxIter=5).fit(sample)
    truth = recommendations.factor_ids(truth_pairs(valid), keep_empty=True)
    return evaluation.compared(
        {
            "collaborative": flat_recommendations(als_recommendations(model)),
            "content": recommendations.factor_ids(content_recs(spark, folder)),
        },
        truth,
    )


# Which users are compared does not depend on the model's solver.
@query("ev5_users_compared", """
select 'collaborative' recommender, count(*) users from (
  select distinct "userId" from samples where part = 'train' and "userId" in (
    select try_cast(regexp_replace(user_id, '^U', '') as integer) from truth))
union all select 'content', count(distinct user_id) from content_recs where user_id in (select user_id from truth)""")
def users_compared(spark, folder):
    return compared(spark, folder).select("recommender", "users")


@query("jn6_recommendations_of_known_users", """
select user_id, news_id, similarity_score, "rank" from popular_recs
where user_id in (select user_id from truth where news_id is not null)""")
def known_users(spark, folder):
    clicked = _truth(spark, folder).na.drop(subset=["news_id"])
    return recommendations.of_known_users(popular_recs(spark, folder), clicked)


@query("jn7_labelled_recommendations", """
select user_id, news_id, similarity_score, "rank",
       (case when (user_id, news_id) in (select user_id, news_id from truth where news_id is not null) then 1 else 0 end)::integer label
from popular_recs""")
def labelled(spark, folder):
    return recommendations.with_label(popular_recs(spark, folder), _truth(spark, folder))


@query("set3_common_users", """
select distinct user_id from popular_recs where user_id in (select user_id from truth where news_id is not null)""")
def common_users(spark, folder):
    clicked = _truth(spark, folder).na.drop(subset=["news_id"])
    return recommendations.common_users(popular_recs(spark, folder), clicked)


@query("set3_common_user_count", """
select count(distinct o_custkey) users from orders where o_custkey in (select user_id from events)""")
def common_user_count(spark, folder):
    buyers = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"))
    readers = table(spark, folder, "events").select("user_id")
    return recommendations.common_users(buyers, readers).agg(F.count(F.lit(1)).alias("users"))
