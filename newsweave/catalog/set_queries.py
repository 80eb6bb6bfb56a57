"""Queries over bitmaps, screened ids and footers."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.catalog.fixtures import behaviors_valid, news, news_valid, popular_recs, table
from newsweave.catalog.registry import query
from newsweave.operators import behaviors, bitmaps
from newsweave.session import new_folder
from newsweave.sinks.done import DoneIds, with_guess
from newsweave.sources import footers


def _clicked(spark, folder):
    return bitmaps.item_words(behaviors.truth_pairs(behaviors_valid(spark, folder)))


@query("agg3_truth_as_bitmaps", """
select user_id, n >> 6 word, count(*) items,
       bit_or(case when n % 64 = 63 then (-9223372036854775807 - 1)::bigint else 1::bigint << (n % 64)::integer end) bits
from (select distinct user_id, substr(news_id, 2)::bigint n from truth where news_id is not null) group by 1, 2""")
def truth_words(spark, folder):
    return _clicked(spark, folder).select("user_id", "word", F.bit_count("bits").cast("bigint").alias("items"), "bits")


@query("agg3_items_of_bitmaps", "select distinct user_id, news_id from truth where news_id is not null")
def truth_items(spark, folder):
    return bitmaps.items_of(_clicked(spark, folder))


@query("jn7_labelled_by_bitmaps", like="jn7_labelled_recommendations")
def labelled(spark, folder):
    return bitmaps.with_label(popular_recs(spark, folder), _clicked(spark, folder))


@query("jn6_known_users_by_bitmaps", like="jn6_recommendations_of_known_users")
def known_users(spark, folder):
    return popular_recs(spark, folder).join(_clicked(spark, folder).select("user_id"), "user_id", "left_semi").select(
        "user_id", "news_id", "similarity_score", "rank")


@query("set3_common_users_by_bitmaps", like="set3_common_users")
def common_users(spark, folder):
    clicked = behaviors.truth_pairs(behaviors_valid(spark, folder)).na.drop(subset=["news_id"])
    both = bitmaps.common(bitmaps.id_bitmaps(popular_recs(spark, folder), "user_id", "U"), bitmaps.id_bitmaps(clicked, "user_id", "U"))
    return bitmaps.ids_of(both, "user_id", "U")


@query("set3_common_user_count_by_bitmaps", like="set3_common_user_count")
def common_user_count(spark, folder):
    buyers = bitmaps.id_bitmaps(table(spark, folder, "orders"), "o_custkey")
    readers = bitmaps.id_bitmaps(table(spark, folder, "events"), "user_id")
    return bitmaps.size_of(bitmaps.common(buyers, readers), "users")


def _done(spark, folder):
    done = DoneIds(spark, new_folder(spark, "done"))
    done.append(news_valid(spark, folder))
    return done


@query("jn1_not_yet_by_bloom_filter", like="jn1_not_yet_processed")
def not_processed(spark, folder):
    return _done(spark, folder).not_yet(news(spark, folder)).select("news_id", "title")


@query("jn1_rows_past_the_bloom_filter", """
select true misses_none, true lets_few_pass""")
def screened(spark, folder):
    """Every done row passes the filter, and of the others one in twenty at most."""
    done = _done(spark, folder)
    guessed = with_guess(news(spark, folder), done.screen(), "news_id", done.words())
    ids = done.ids().distinct().withColumn("_done", F.lit(True))
    facts = guessed.join(ids, "news_id", "left").agg(
        F.count_if(F.col("_done") & ~F.col("_maybe")).alias("missed"),
        F.count_if(F.col("_done").isNull() & F.col("_maybe")).alias("passed"), F.count_if(F.col("_done").isNull()).alias("others"))
    return facts.select((F.col("missed") == 0).alias("misses_none"), (F.col("passed") * 20 <= F.col("others")).alias("lets_few_pass"))


def _paths(folder, *names):
    return {name: f"{folder}/{name}.parquet" for name in names}


@query("agg10_rows_and_bounds_from_footers", """
select count(*) "rows", count(event_id) n_event_id, min(event_id) low_event_id, max(event_id) high_event_id,
       count(user_id) n_user_id, min(user_id) low_user_id, max(user_id) high_user_id from events""")
def bounds(spark, folder):
    return footers.stored_bounds(spark, f"{folder}/events.parquet", ["event_id", "user_id"])


@query("src8_readiness_from_footers", """
select 'documents' table_name, count(doc_id) > 0 ready from documents
union all select 'labels', count(doc_id) > 0 from labels
union all select 'events', false""")
def readiness(spark, folder):
    return footers.stored_readiness(spark, _paths(folder, "documents", "labels", "events"), "doc_id")


@query("snk3_load_plan_from_footers", like="snk3_load_plan")
def load_plan(spark, folder):
    return footers.stored_load_plan(spark, _paths(folder, "events", "nation"), {"events": 500, "nation": 25})
