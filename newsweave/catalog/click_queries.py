"""Click logs: projections, labels, ids, sampling, splits and truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.catalog.fixtures import (
    behaviors, behaviors_train, behaviors_valid, clicks,
)
from newsweave.catalog.registry import VIEWS, query
from newsweave.functions.clicks import (
    click_label, click_time, numeric_id, repeatable_key, shown_item,
)
from newsweave.operators import behaviors as ops


def _items(spark, folder):
    return ops.interactions(behaviors_train(spark, folder))


@query("fn1_renamed_behaviors", """
select impression_id "impressionId", user_id "userId", "time" "timestamp", history clicked, impressions
from behaviors_train""")
def renamed(spark, folder):
    return ops.renamed_behaviors(behaviors_train(spark, folder))


@query("fn2_shown_items", """
select impression_id, user_id, "position"::integer "position", impression from shown""")
def shown(spark, folder):
    return ops.shown_items(behaviors_train(spark, folder))


@query("fn3_click_label", """
select impression, (case when suffix(impression, '-1') then 1 else 0 end)::integer clicked, count(*) n
from shown group by 1, 2""")
def label(spark, folder):
    return ops.shown_items(behaviors_train(spark, folder)).select(
        "impression", click_label(F.col("impression")).alias("clicked")
    ).groupBy("impression", "clicked").agg(F.count(F.lit(1)).alias("n"))


@query("fn4_shown_item_id", """
select split_part(impression, '-', 1) news_id, count(*) n from shown group by 1""")
def item_id(spark, folder):
    return ops.shown_items(behaviors_train(spark, folder)).select(
        shown_item(F.col("impression")).alias("news_id")
    ).groupBy("news_id").agg(F.count(F.lit(1)).alias("n"))


@query("fn5_numeric_ids", """
select e.event_id, e.event_type || e.user_id bad_id, try_cast(e.event_type || e.user_id as integer) bad_number,
       try_cast(regexp_replace('U' || e.user_id, '^U', '') as integer) user_number,
       try_cast(regexp_replace('N' || e.k, '^N', '') as integer) item_number
from clicks e""")
def numeric(spark, folder):
    bad = F.concat("event_type", "user_id")
    return clicks(spark, folder).select(
        "event_id", bad.alias("bad_id"), numeric_id(bad, "U").alias("bad_number"),
        numeric_id(F.concat(F.lit("U"), "user_id"), "U").alias("user_number"),
        numeric_id(F.concat(F.lit("N"), "k"), "N").alias("item_number"),
    )


@query("fn6_rows_with_values", """
select impression_id, user_id, history from behaviors_train where history is not null and impressions is not null""")
def with_values(spark, folder):
    return ops.with_values(behaviors_train(spark, folder), "history", "impressions").select(
        "impression_id", "user_id", "history"
    )


@query("fn7_clicked_and_not_clicked", """
select 'positive' side, "userId", "newsId", count(*) n from items where clicked = 1 group by all
union all
select 'negative' side, "userId", "newsId", count(*) n from items where clicked = 0 group by all""")
def sides(spark, folder):
    items = _items(spark, folder)
    parts = [
        rows.groupBy("userId", "newsId").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
        for side, rows in (("positive", ops.positives(items)), ("negative", ops.negatives(items)))
    ]
    return parts[0].unionByName(parts[1])


@query("fn8_repeatable_random_key", """
select event_id, md5(concat_ws('|', '47', user_id::varchar, k::varchar, event_id::varchar)) "key" from clicks""")
def random_key(spark, folder):
    return clicks(spark, folder).select(
        "event_id", repeatable_key(47, F.col("user_id"), F.col("k"), F.col("event_id")).alias("key")
    )


@query("fn9_history_items", "select impression_id, user_id, news_id from history_rows")
def history(spark, folder):
    return ops.history_items(behaviors_train(spark, folder))


@query("click_time_parsed", """
select impression_id, strftime(d, '%Y-%m-%d') "day" from behaviors""")
def parsed_time(spark, folder):
    return behaviors(spark, folder).select(
        "impression_id", F.date_format(click_time(F.col("time")), "yyyy-MM-dd").alias("day")
    )


@query("interactions", 'select "userId", "newsId", clicked, impression_id, "position"::integer "position" from items')
def interactions(spark, folder):
    return _items(spark, folder)


@query("win1_negative_sampling", """
select "userId", "newsId", impression_id, "position"::integer "position" from negative_ranks where r <= 4""")
def negative_sampling(spark, folder):
    return ops.sampled_negatives(_items(spark, folder)).select("userId", "newsId", "impression_id", "position")


@query("win1_negatives_per_positive", """
select "userId", "newsId", impression_id, "position"::integer "position" from negative_ranks
join (select "userId", count(*) * 2 quota from items where clicked = 1 group by 1) using ("userId")
where r <= quota""")
def negatives_per_positive(spark, folder):
    return ops.sampled_negatives(_items(spark, folder), npratio=2, per_positive=True).select(
        "userId", "newsId", "impression_id", "position"
    )


@query("set2_positives_and_negatives", """
select "userId", "newsId", clicked from items where clicked = 1
union all
select "userId", "newsId", clicked from negative_ranks where r <= 4""")
def training_sample(spark, folder):
    return ops.training_sample(behaviors_train(spark, folder))


VIEWS["valid_items"] = """
  select try_cast(regexp_replace(user_id, '^U', '') as integer) "userId",
         try_cast(regexp_replace(split_part(i, '-', 1), '^N', '') as integer) "newsId",
         (case when suffix(i, '-1') then 1 else 0 end)::integer clicked, impression_id, "position"
  from (select impression_id, user_id, unnest(string_split(impressions, ' ')) i,
               unnest(range(len(string_split(impressions, ' ')))) "position" from behaviors_valid)"""
VIEWS["valid_ranks"] = """
  select *, row_number() over (partition by "userId" order by md5(concat_ws('|', '47', "userId"::varchar,
         "newsId"::varchar, impression_id::varchar, "position"::varchar)), impression_id, "position") r
  from valid_items where clicked = 0"""
VIEWS["samples"] = """
select 'train' part, "userId", "newsId", clicked from items where clicked = 1
union all select 'train', "userId", "newsId", clicked from negative_ranks where r <= 4
union all select 'valid', "userId", "newsId", clicked from valid_items where clicked = 1
union all select 'valid', "userId", "newsId", clicked from valid_ranks where r <= 4"""


@query("ml1_training_samples", "select part, \"userId\", \"newsId\", clicked from samples")
def training_samples(spark, folder):
    train, valid = ops.training_samples(behaviors_train(spark, folder), behaviors_valid(spark, folder))
    return train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))


@query("ml6_repeatable_split", """
select event_id, case when ('0x' || substr(md5(concat_ws('|', '47', event_id::varchar)), 1, 8))::bigint
       / 4294967296.0::double < 0.8::double then 'train' else 'test' end part
from clicks""")
def split(spark, folder):
    train, test = ops.repeatable_split(clicks(spark, folder), ["event_id"])
    return train.select("event_id", F.lit("train").alias("part")).unionByName(
        test.select("event_id", F.lit("test").alias("part"))
    )


@query("agg3_ground_truth", """
select user_id, coalesce(string_agg(news_id, ' ' order by news_id), '') relevant, count(news_id) n
from truth group by 1""")
def ground_truth(spark, folder):
    return ops.ground_truth(behaviors_valid(spark, folder)).select(
        "user_id", F.array_join("relevant", " ").alias("relevant"), F.size("relevant").cast("bigint").alias("n")
    )
