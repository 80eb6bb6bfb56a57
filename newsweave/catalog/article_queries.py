"""Articles: text, tokens, token vectors, combining, counting and paging."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from newsweave.catalog import fixtures as fx
from newsweave.catalog.fixtures import clicks, news, news_valid, positions, rounded_sql, table, token_lists, token_vectors
from newsweave.catalog.registry import query
from newsweave.constants import CRAWLED_COLUMNS
from newsweave.functions.intervals import interval_number, intervals_of
from newsweave.functions.text import clean_text, combined_text, tokens, without_stop_words
from newsweave.operators import corpus, ranking, text_vectors, vectors
from newsweave.sources.tables import latest_news


@query("fn10_combined_text", """
select news_id, concat_ws(' ', title, abstract) combined,
       concat_ws(' ', title, nullif(subcategory, 'en'), abstract) three_fields
from news_train""")
def combined(spark, folder):
    return news(spark, folder).select(
        "news_id", combined_text(F.col("title"), F.col("abstract")).alias("combined"),
        combined_text(F.col("title"), F.nullif("subcategory", F.lit("en")), F.col("abstract")).alias("three_fields"),
    )


@query("fn11_clean_text", """
select news_id, clean_text from cleaned_news""")
def clean(spark, folder):
    return news(spark, folder).select(
        "news_id", clean_text(combined_text(F.col("title"), F.col("abstract"))).alias("clean_text")
    )


@query("txt1_tokens", """
select news_id, len(w)::bigint words, array_to_string(w, '|') joined
from (select news_id, list_filter(string_split(clean_text, ' '), lambda x: x <> '') w from cleaned_news)""")
def token_list(spark, folder):
    words = text_vectors.cleaned(news(spark, folder)).select("news_id", tokens(F.col("clean_text")).alias("w"))
    return words.select(
        "news_id", F.size("w").cast("bigint").alias("words"), F.array_join("w", "|").alias("joined")
    )


@query("txt2_without_stop_words", """
select news_id, len(tokens)::bigint words, array_to_string(tokens, '|') joined from token_lists""")
def stop_words(spark, folder):
    words = text_vectors.cleaned(news(spark, folder)).select("news_id", tokens(F.col("clean_text")).alias("w"))
    kept = words.withColumn("w", without_stop_words(F.col("w"), fx.STOP_WORDS))
    return kept.select(
        "news_id", F.size("w").cast("bigint").alias("words"), F.array_join("w", "|").alias("joined")
    )


@query("txt3_token_vectors", f"""
select news_id, "position"::integer "position", token, {rounded_sql('vector[1]')} first_value,
       {rounded_sql('vector[len(vector)]')} last_value
from (select news_id, unnest(tokens) token, unnest(range(len(tokens))) "position" from token_lists)
join token_vectors using (token)""")
def vectors_of_tokens(spark, folder):
    rows = text_vectors.token_rows(token_lists(spark, folder))
    found = text_vectors.with_token_vectors(rows, token_vectors(spark, folder))
    return found.select(
        "news_id", "position", "token",
        fx.rounded(F.element_at("vector", 1).cast("double")).alias("first_value"),
        fx.rounded(F.element_at("vector", -1).cast("double")).alias("last_value"),
    )


@query("txt4_document_vectors", f"select news_id, pos, {rounded_sql('x')} \"value\" from document_values")
def document_vectors(spark, folder):
    found = text_vectors.document_vectors(token_lists(spark, folder), token_vectors(spark, folder))
    return positions(found, "news_id", "embedding")


@query("txt5_token_level_vectors", f"""
with placed as (
  select news_id, vector, row_number() over (partition by news_id order by p) n
  from (select news_id, unnest(tokens) token, unnest(range(len(tokens))) p from token_lists)
  join token_vectors using (token))
select news_id, n "position", {rounded_sql('list_sum(vector)', 5)} total from placed""")
def token_level(spark, folder):
    found = text_vectors.token_level_vectors(token_lists(spark, folder), token_vectors(spark, folder))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("news_id", F.posexplode("embedding").alias("at", "vector")).select(
        "news_id", (F.col("at") + 1).cast("bigint").alias("position"), fx.rounded(total, 5).alias("total")
    )


@query("txt6_fitted_text_stages")
def fitted_stages(spark, folder):
    _, found = text_vectors.fitted_and_transformed(text_vectors.text_pipeline(fx.STOP_WORDS, vector_size=16), news(spark, folder))
    found = vectors.from_ml_vector(found, "embedding", "embedding")
    return found.select("news_id", F.size("tokens").alias("words"), "embedding")


# What learned word vectors do not touch: each article's words and vector length.
@query("txt6_words_of_fitted_stages", """
select news_id, len(tokens)::integer words, 16::integer dimension from token_lists""")
def words_of_fitted_stages(spark, folder):
    return fitted_stages(spark, folder).select("news_id", "words", F.size("embedding").alias("dimension"))


# Words by the company they keep: signed hash vectors summed over the words around.
@query("txt6_hashed_word_vectors", """
with places as (select news_id, unnest(tokens) token, unnest(range(len(tokens))) p from token_lists),
sides as (
  select token, unnest([lag(token, 2) over w, lag(token) over w, lead(token) over w, lead(token, 2) over w]) other
  from places window w as (partition by news_id order by p)),
near as (select * from sides where other is not null),
pairs as (select token, other, count(*) n from near group by 1, 2),
entries as (
  select token, n, ('0x' || substr(md5(other || '#' || j), 1, 8))::bigint pos_hash, ('0x' || substr(md5(other || '#' || j), 9, 1))::bigint % 2 sign_bit
  from pairs, (select unnest(range(4)) j)),
vectors as (
  select token, (pos_hash % 64)::bigint + 1 pos, sum(case when sign_bit = 0 then n else -n end)::bigint v from entries group by 1, 2)
select token, count(*) entries, sum(v * v)::bigint squared_length, sum(v * pos)::bigint weighted from vectors group by 1""")
def hashed_word_vectors(spark, folder):
    found = text_vectors.hashed_contexts(text_vectors.token_rows(fx.token_lists(spark, folder)), size=64, window=2, entries=4)
    value = F.col("value")
    # One row per word; its entries are folded into three numbers.
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("entries"), F.sum(value * value).alias("squared_length"),
                                      F.sum(value * F.col("pos")).alias("weighted"))


# The text of crawled articles is title, summary and excerpt.
@query("txt2_words_of_crawled_articles", """
with texts as (
  select page_id, lower(regexp_replace(concat_ws(' ', url, html, url), '[^a-zA-Z0-9 ]', '', 'g')) clean_text from pages)
select page_id::varchar _id, len(list_filter(string_split(clean_text, ' '), lambda x: x <> ''))::bigint words, length(clean_text)::bigint chars from texts""")
def words_of_crawled(spark, folder):
    pages = table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("_id"), F.col("url").alias("title"), F.col("html").alias("summary"), F.col("url").alias("excerpt"))
    found = text_vectors.tokenised(text_vectors.cleaned(pages, ("title", "summary", "excerpt")))
    return found.select("_id", F.size("tokens").cast("bigint").alias("words"), F.length("clean_text").cast("bigint").alias("chars"))


@query("txt7_new_document_vectors", f"""
select news_id, pos, {rounded_sql('x')} "value" from document_values
where news_id not in (select news_id from news_valid)""")
def new_vectors(spark, folder):
    found = text_vectors.new_document_vectors(
        news(spark, folder), news_valid(spark, folder), token_vectors(spark, folder), fx.STOP_WORDS
    )
    return positions(found, "news_id", "embedding")


def letter_shares(texts: list[str]) -> np.ndarray:
    """A toy encoder: length of the text and its counts of a and e."""
    return np.array([[len(t), t.count("a"), t.count("e")] for t in texts], dtype="float32").reshape(-1, 3)


@query("udf4_encoder_hook", """
select news_id, length(clean_text)::double "length", (length(clean_text) - length(replace(clean_text, 'a', '')))::double a,
       (length(clean_text) - length(replace(clean_text, 'e', '')))::double e
from cleaned_news""")
def encoder_hook(spark, folder):
    found = text_vectors.encoded(text_vectors.cleaned(news(spark, folder)), letter_shares)
    return found.select("news_id", *[
        F.get("embedding", i).cast("double").alias(name) for i, name in enumerate(["length", "a", "e"])
    ])


@query("jn1_not_yet_processed", """
select news_id, title from news_train where news_id not in (select news_id from news_valid)""")
def not_processed(spark, folder):
    return corpus.not_yet(news(spark, folder), news_valid(spark, folder)).select("news_id", "title")


@query("set1_union_all", """
select news_id, subcategory, title from news_train union all select news_id, subcategory, title from news_valid""")
def union(spark, folder):
    return corpus.union_all(news(spark, folder), news_valid(spark, folder)).select("news_id", "subcategory", "title")


@query("agg5_last_wins", """
select news_id, coalesce(v.subcategory, t.subcategory) subcategory, t.title
from news_train t left join news_valid v using (news_id)""")
def last_wins(spark, folder):
    both = corpus.in_order(news(spark, folder), news_valid(spark, folder))
    return corpus.last_wins(both, "news_id", ["source_order"]).select("news_id", "subcategory", "title")


@query("agg5_last_wins_among_ties", """
with rows as (select doc_id % 50 key, lang, source, n_chars from documents),
marked as (select *, md5(concat_ws(chr(31), key::varchar, coalesce(lang, chr(30)), coalesce(source, chr(30)), n_chars::varchar)) m from rows)
select key, lang, source, n_chars from (
  select *, row_number() over (partition by key order by lang desc, m desc) r from marked) where r = 1""")
def last_wins_among_ties(spark, folder):
    rows = table(spark, folder, "documents").select(
        (F.col("doc_id") % 50).alias("key"), "lang", "source", "n_chars"
    )
    return corpus.last_wins(rows, "key", ["lang"])


@query("agg6_any_row_per_key", "select distinct news_id from news_train")
def any_row(spark, folder):
    both = corpus.union_all(news(spark, folder), news_valid(spark, folder))
    return corpus.any_per_key(both, "news_id").select("news_id")


@query("agg7_duplicate_titles", """
with tabled as (select news_id, title from news_train union all select news_id, title from news_valid)
select news_id, title, count(*) copies, (sum(count(*)) over (partition by news_id))::bigint total
from tabled group by 1, 2 qualify sum(count(*)) over (partition by news_id) > 1""")
def duplicates(spark, folder):
    both = corpus.union_all(news(spark, folder), news_valid(spark, folder))
    return corpus.duplicate_titles(both, "news_id", "title")


@query("agg10_row_counts", """
select 'news' table_name, count(*) "rows" from news_train
union all select 'events', count(*) from events""")
def row_counts(spark, folder):
    return corpus.union_all(*[
        corpus.row_count(df).withColumn("table_name", F.lit(name))
        for name, df in (("news", news(spark, folder)), ("events", table(spark, folder, "events")))
    ])


def _paged(spark, folder):
    return clicks(spark, folder).select(
        # Some groups have no topic.
        "event_id", F.nullif("event_type", F.lit("view")).alias("topic"),
        F.date_format("d", "yyyy-MM").alias("interval"),
        F.when(F.col("user_id") % 7 > 0, F.concat(F.lit("site"), F.col("user_id") % 7)).alias("source"),
        F.md5(F.col("event_id").cast("string")).alias("relevance"),
    )


_PAGED = """
with paged as (
  select event_id, nullif(event_type, 'view') topic, strftime(d, '%Y-%m') "interval",
         case when user_id % 7 > 0 then 'site' || (user_id % 7) end source, md5(event_id::varchar) relevance
  from clicks),
numbered as (
  select *, (row_number() over (partition by topic, "interval" order by relevance, event_id) - 1) // 100 page from paged),
counted as (
  select *, count(*) over (partition by topic, "interval", source order by page
         range between unbounded preceding and 1 preceding) earlier from numbered {where})
select event_id, page from counted where source is null or earlier <= {cap}"""


@query("agg12_capped_sources", _PAGED.format(where="", cap=20))
def capped(spark, folder):
    kept = corpus.capped_sources(
        _paged(spark, folder), ["topic", "interval"], "source", ["relevance", "event_id"], cap=20, max_pages=None
    )
    return kept.select("event_id", "page")


@query("agg12_capped_sources_five_pages", _PAGED.format(where="where page < 5", cap=20))
def capped_five_pages(spark, folder):
    kept = corpus.capped_sources(
        _paged(spark, folder), ["topic", "interval"], "source", ["relevance", "event_id"], cap=20, max_pages=5
    )
    return kept.select("event_id", "page")


@query("fn16_crawled_fields", """
select page_id::varchar _id, null::varchar title, null::varchar author, url link, html summary, null::varchar excerpt,
       null::varchar published_date
from pages""")
def crawled(spark, folder):
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("_id"), F.col("url").alias("link"), F.col("html").alias("summary")
    )
    return corpus.crawled_fields(pages).select(*CRAWLED_COLUMNS)


@query("fn21_time_intervals", """
with b as (select date_trunc('second', min(ts)) s, date_trunc('second', max(ts)) e from events),
l as (select s, e, floor((epoch(e) - epoch(s)) / 10)::bigint len, unnest(range(10)) i from b)
select i "interval", strftime(s + to_seconds(i * len), '%Y-%m-%d %H:%M:%S') interval_start,
       strftime(case when i = 9 then e else s + to_seconds((i + 1) * len - 1) end, '%Y-%m-%d %H:%M:%S') interval_end
from l""")
def intervals(spark, folder):
    bounds = _bounds(spark, folder)
    return intervals_of(bounds, 10).select("interval", "interval_start", "interval_end")


def _bounds(spark, folder):
    return table(spark, folder, "events").agg(
        F.date_trunc("second", F.min("ts").cast("timestamp")).alias("start"),
        F.date_trunc("second", F.max("ts").cast("timestamp")).alias("end"),
    )


@query("fn21_events_per_interval", """
with b as (select date_trunc('second', min(ts)) s, date_trunc('second', max(ts)) e from events)
select least(floor((floor(epoch(ts)) - epoch(s)) / floor((epoch(e) - epoch(s)) / 10)), 9)::bigint "interval", count(*) n
from events, b group by 1""")
def events_per_interval(spark, folder):
    # One row of bounds.
    bounds = _bounds(spark, folder).first()
    start, end = F.lit(bounds["start"]), F.lit(bounds["end"])
    number = interval_number(F.col("ts").cast("timestamp"), start, end, 10)
    return table(spark, folder, "events").groupBy(number.cast("bigint").alias("interval")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("fn22_selected_articles", """
with a as (select event_id, event_type topic, ts, case when user_id % 7 > 0 then 'site' || (user_id % 7) end source
           from events)
select event_id, topic, source from a
where topic in ('click', 'view') and ts between timestamp '2024-01-05' and timestamp '2024-01-20'
  and (source is null or source not in ('site1', 'site2'))""")
def selected(spark, folder):
    articles = clicks(spark, folder).select(
        "event_id", F.col("event_type").alias("topic"), "ts",
        F.when(F.col("user_id") % 7 > 0, F.concat(F.lit("site"), F.col("user_id") % 7)).alias("source"),
    )
    start, end = F.to_timestamp_ntz(F.lit("2024-01-05")), F.to_timestamp_ntz(F.lit("2024-01-20"))
    return corpus.selected_articles(
        articles, ["click", "view"], start, end, ts="ts", excluded=["site1", "site2"]
    ).select("event_id", "topic", "source")


@query("fn22_many_requests", """
with a as (select event_id, event_type topic, ts, case when user_id % 7 > 0 then 'site' || (user_id % 7) end source from events),
requests as (
  select c_custkey request_id, case when c_custkey % 3 = 0 then 'click' when c_custkey % 3 = 1 then 'view' else 'purchase' end topic,
         timestamp '2024-01-01' + to_hours((c_custkey * 37) % 700) s, timestamp '2024-01-01' + to_hours((c_custkey * 37) % 700 + c_custkey % 200) e
  from customer)
select request_id, count(*) articles, min(event_id) first_event, max(event_id) last_event
from requests r join a on a.topic = r.topic and a.ts between r.s and r.e
where source is null or source not in ('site1', 'site2') group by 1""")
def many_requests(spark, folder):
    articles = clicks(spark, folder).select(
        "event_id", F.col("event_type").alias("topic"), "ts",
        F.when(F.col("user_id") % 7 > 0, F.concat(F.lit("site"), F.col("user_id") % 7)).alias("source"),
    )
    key, first = F.col("c_custkey"), F.to_timestamp_ntz(F.lit("2024-01-01"))
    topic = F.when(key % 3 == 0, "click").when(key % 3 == 1, "view").otherwise("purchase")
    requests = table(spark, folder, "customer").select(
        key.alias("request_id"), topic.alias("topic"), (first + F.make_dt_interval(hours=((key * 37) % 700).cast("int"))).alias("start"),
        (first + F.make_dt_interval(hours=((key * 37) % 700 + key % 200).cast("int"))).alias("end"))
    found = corpus.requested_articles(articles, requests, ts="ts", excluded=["site1", "site2"], totals="event_id")
    return found.select("request_id", "articles", F.col("least").alias("first_event"), F.col("greatest").alias("last_event"))


@query("win2_batch_numbers", """
select news_id, row_number() over (order by news_id) row_num, (row_number() over (order by news_id) - 1) // 50 batch
from news_train""")
def batches(spark, folder):
    return ranking.batch_numbers(news(spark, folder).select("news_id"), "news_id", 50)


@query("win3_distributed_index", """
select event_id, row_number() over (order by md5(event_id::varchar), event_id) - 1 unique_id,
       (row_number() over (order by md5(event_id::varchar), event_id) - 1) // 50 batch_num
from clicks""")
def index(spark, folder):
    return ranking.distributed_index(clicks(spark, folder).select("event_id"), "event_id", 50)


@query("win6_first_rows", 'select event_id, user_id, "value" from events order by "value" desc, event_id limit 10')
def first(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    return corpus.first_rows(events, [F.desc("value"), F.col("event_id")])


@query("src6_latest_news", """
select news_id, coalesce(v.subcategory, t.subcategory) subcategory, t.category
from news_train t left join news_valid v using (news_id)""")
def latest(spark, folder):
    return latest_news(news(spark, folder), news_valid(spark, folder)).select("news_id", "subcategory", "category")
