"""Click logs, articles and vectors derived from the test tables, in Spark and
as SQL views of the same content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsweave.catalog.registry import VIEWS
from newsweave.operators.joins import lookup_join
from newsweave.operators.text_vectors import cleaned, token_rows, tokenised
from newsweave.session import new_folder
from newsweave.sources.tables import spread

SPLIT_DAY = "2024-01-24"
# A short stop-word list that both engines are given.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "der", "die", "el", "en", "for", "from", "in",
    "is", "it", "la", "le", "of", "on", "or", "that", "the", "to", "und", "was", "were", "with",
]


_TOKEN_TABLES: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    result = F.round(value, digits)
    return F.when(result == 0, F.lit(0.0)).otherwise(result)


def rounded_sql(value: str, digits: int = 6) -> str:
    return f"case when round({value}, {digits}) = 0 then 0.0::double else round({value}, {digits}) end"


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their item number and day."""
    return table(spark, folder, "events").select(
        "user_id", "event_id", "event_type", "ts",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.col("ts").cast("date").alias("d"),
        F.col("event_type").isin("click", "purchase").alias("positive"),
    )


VIEWS["clicks"] = """
select user_id, event_id, event_type, ts, cast(json_extract_string(props, '$.k') as bigint) k,
       cast(ts as date) d, event_type in ('click', 'purchase') positive
from events"""


def _joined_items(text: Column) -> Column:
    items = F.array_sort(F.collect_list(F.struct("event_id", text.alias("item"))))
    return F.array_join(F.transform(items, lambda x: x["item"]), " ")


def behaviors(spark: SparkSession, folder: str) -> DataFrame:
    """The click log: a row per user and day, as long as what one user sees in one
    day. The history is what the user clicked the day before, null if nothing. The
    first row of users with an odd number has its own day's clicks as history, as
    if they had been here before; that of the others has none."""
    event = clicks(spark, folder)
    item = F.concat(F.lit("N"), F.col("k"))
    shown = F.concat(item, F.when(F.col("positive"), "-1").otherwise("-0"))
    days = event.groupBy("user_id", "d").agg(
        F.min("event_id").alias("impression_id"),
        _joined_items(shown).alias("impressions"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("positive"), F.struct("event_id", item.alias("item")))
        )), lambda x: x["item"]), " ").alias("clicks"),
    )
    before = days.filter(F.col("clicks") != "").select(
        "user_id", F.date_add("d", 1).alias("d"), F.col("clicks").alias("history")
    )
    firsts = days.groupBy("user_id").agg(F.min("impression_id").alias("impression_id")).select(
        "user_id", "impression_id", (F.col("user_id") % 2 == 1).alias("_known")
    )
    own = F.when(F.col("_known"), F.nullif("clicks", F.lit("")))
    logged = days.join(before, ["user_id", "d"], "left").join(firsts, ["user_id", "impression_id"], "left")
    return logged.withColumn("history", F.when(F.col("_known").isNull(), F.col("history")).otherwise(own)).select(
        "impression_id",
        F.concat(F.lit("U"), F.col("user_id")).alias("user_id"),
        F.concat(F.date_format("d", "M/d/yyyy"), F.lit(" 12:00:00 AM")).alias("time"),
        "history", "impressions", "d",
    )


VIEWS["days"] = """
select user_id, d, min(event_id) impression_id,
       string_agg('N' || k || (case when positive then '-1' else '-0' end), ' ' order by event_id) impressions,
       string_agg('N' || k, ' ' order by event_id) filter (where positive) clicked_items
from clicks group by 1, 2"""
VIEWS["behaviors"] = """
select a.impression_id, 'U' || a.user_id user_id, strftime(a.d, '%-m/%-d/%Y') || ' 12:00:00 AM' "time",
       case when f.impression_id is null then b.clicked_items when a.user_id % 2 = 1 then a.clicked_items end history,
       a.impressions, a.d
from days a left join days b on a.user_id = b.user_id and a.d = b.d + 1
left join (select user_id, min(impression_id) impression_id from days group by 1) f
  on a.user_id = f.user_id and a.impression_id = f.impression_id"""


def behaviors_train(spark: SparkSession, folder: str) -> DataFrame:
    return behaviors(spark, folder).filter(F.col("d") < F.lit(SPLIT_DAY).cast("date")).drop("d")


def behaviors_valid(spark: SparkSession, folder: str) -> DataFrame:
    return behaviors(spark, folder).filter(F.col("d") >= F.lit(SPLIT_DAY).cast("date")).drop("d")


VIEWS["behaviors_train"] = f"select * exclude (d) from behaviors where d < date '{SPLIT_DAY}'"
VIEWS["behaviors_valid"] = f"select * exclude (d) from behaviors where d >= date '{SPLIT_DAY}'"
VIEWS["shown"] = """
select impression_id, user_id, unnest(range(len(string_split(impressions, ' ')))) "position",
       unnest(string_split(impressions, ' ')) impression
from behaviors_train"""
VIEWS["items"] = """
select try_cast(regexp_replace(user_id, '^U', '') as integer) "userId",
       try_cast(regexp_replace(split_part(impression, '-', 1), '^N', '') as integer) "newsId",
       (case when suffix(impression, '-1') then 1 else 0 end)::integer clicked, impression_id, "position"
from shown"""
VIEWS["negative_ranks"] = """
select *, row_number() over (partition by "userId" order by md5(concat_ws('|', '47', "userId"::varchar,
       "newsId"::varchar, impression_id::varchar, "position"::varchar)), impression_id, "position") r
from items where clicked = 0"""
VIEWS["history_rows"] = """
select impression_id, user_id, unnest(list_filter(string_split(history, ' '), lambda x: x <> '')) news_id
from behaviors_train where history is not null"""
VIEWS["truth"] = """
select distinct user_id, case when suffix(i, '-1') then split_part(i, '-', 1) end news_id
from (select user_id, unnest(string_split(impressions, ' ')) i from behaviors_valid)"""


def news(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles: the first line is the title, the rest the
    abstract, null when there is none."""
    title = F.substring_index("text", "\n", 1)
    rest = F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)")
    return spread(table(spark, folder, "documents"), "doc_id").select(
        F.concat(F.lit("N"), F.col("doc_id")).alias("news_id"),
        F.col("source").alias("category"), F.col("lang").alias("subcategory"),
        title.alias("title"), F.nullif(rest, F.lit("")).alias("abstract"),
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("url"),
        F.lit(None).cast("string").alias("title_entities"),
        F.lit(None).cast("string").alias("text_entities"),
    )


VIEWS["news_train"] = """
select 'N' || doc_id news_id, source category, lang subcategory, split_part("text", chr(10), 1) title,
       nullif(substr("text", length(split_part("text", chr(10), 1)) + 2), '') abstract,
       'doc/' || doc_id url, null::varchar title_entities, null::varchar text_entities
from documents"""


def news_valid(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled articles again, with their quality as subcategory."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = labels.select(
        F.concat(F.lit("N"), F.col("doc_id")).alias("news_id"),
        F.concat(F.lit("quality"), F.col("quality")).alias("_quality"),
    )
    columns = news(spark, folder).columns
    return news(spark, folder).join(labelled, "news_id").withColumn("subcategory", F.col("_quality")).select(*columns)


VIEWS["news_valid"] = """
select t.* replace ('quality' || l.q as subcategory)
from news_train t join (select 'N' || doc_id news_id, max(quality) q from labels group by 1) l using (news_id)"""
VIEWS["cleaned_news"] = """
select *, concat_ws(' ', title, abstract) combined_text,
       lower(regexp_replace(concat_ws(' ', title, abstract), '[^a-zA-Z0-9 ]', '', 'g')) clean_text
from news_train"""
_STOPS_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
VIEWS["token_lists"] = f"""
select news_id, list_filter(string_split(clean_text, ' '), lambda x: x <> '' and not list_contains([{_STOPS_SQL}], x)) tokens
from cleaned_news"""


def token_lists(spark: SparkSession, folder: str) -> DataFrame:
    return tokenised(cleaned(news(spark, folder)), STOP_WORDS).select("news_id", "tokens")


def token_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A vector for every word of three or more letters, picked among the
    embeddings by the word's hash, as a table that is stored once per application."""
    known = (spark.sparkContext.applicationId, folder)
    if known in _TOKEN_TABLES:
        return spark.read.parquet(_TOKEN_TABLES[known])
    vectors = table(spark, folder, "embeddings")
    rows = vectors.count()
    words = token_rows(token_lists(spark, folder)).select("token").distinct()
    number = F.pmod(F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint"), F.lit(rows))
    cores = spark.sparkContext.defaultParallelism
    picked = words.filter(F.length("token") >= 3).withColumn("vec_id", number).repartition(cores, "token")
    path = new_folder(spark, "tokens")
    lookup_join(picked, vectors.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select(
        "token", "vector"
    ).write.parquet(path)
    _TOKEN_TABLES[known] = path
    return spark.read.parquet(path)


VIEWS["token_numbers"] = """
select token, ('0x' || substr(md5(token), 1, 8))::bigint % (select count(*) from embeddings) vec_id
from (select distinct unnest(tokens) token from token_lists) where length(token) >= 3"""
VIEWS["token_vectors"] = "select token, embedding::double[] vector from token_numbers join embeddings using (vec_id)"
VIEWS["document_sums"] = """
select news_id, vec_id, sum(w) w from (
  select news_id, token, count(*) w from (select news_id, unnest(tokens) token from token_lists) group by 1, 2)
join token_numbers using (token) group by 1, 2"""
VIEWS["document_values"] = """
select news_id, pos, sum(w * x) / sum(w) x from (
  select news_id, w, unnest(embedding)::double x, unnest(range(1, len(embedding) + 1)) pos
  from document_sums join embeddings using (vec_id)) group by 1, 2"""


def article_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as article vectors."""
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("N"), F.col("vec_id")).alias("news_id"), "embedding",
        F.concat(F.lit("c"), F.col("label")).alias("category"),
    )


VIEWS["article_vectors"] = """
select 'N' || vec_id news_id, embedding::double[] embedding, 'c' || label category from embeddings"""


def clicked_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, news_id) of every click, with the numbers of the tables."""
    return clicks(spark, folder).filter("positive").select("user_id", F.col("k").alias("news_id"))


VIEWS["click_profiles"] = """
select user_id, list(m order by pos) p from (
  select user_id, pos, avg(v) m from (
    select c.user_id, unnest(m.embedding)::double v, unnest(range(1, len(m.embedding) + 1)) pos
    from clicks c join embeddings m on c.k = m.vec_id where c.positive) group by 1, 2) group by 1"""
VIEWS["nearest"] = """
select user_id, news_id, similarity_score, "rank" from (
  select *, row_number() over (partition by user_id order by similarity_score desc, news_id) "rank" from (
    select user_id, vec_id news_id, round(list_cosine_similarity(p, embedding::double[]), 9) similarity_score
    from click_profiles, embeddings)) where "rank" <= 10"""
VIEWS["train_profiles"] = """
select user_id, list(m order by pos) p from (
  select user_id, pos, avg(v) m from (
    select h.user_id, unnest(a.embedding) v, unnest(range(1, len(a.embedding) + 1)) pos
    from history_rows h join article_vectors a using (news_id)) group by 1, 2) group by 1"""
VIEWS["first_profiles"] = """
select user_id, list(m order by pos) p from (
  select user_id, pos, avg(v) m from (
    select h.user_id, unnest(a.embedding) v, unnest(range(1, len(a.embedding) + 1)) pos
    from history_rows h join article_vectors a using (news_id)
    where h.impression_id in (select min(impression_id) from behaviors_train group by user_id)
  ) group by 1, 2) group by 1"""
VIEWS["content_recs"] = """
select user_id, news_id, similarity_score, "rank" from (
  select *, row_number() over (partition by user_id order by similarity_score desc, news_id) "rank" from (
    select user_id, news_id, round(list_cosine_similarity(p, embedding), 9) similarity_score
    from first_profiles, article_vectors)) where "rank" <= 10"""
# The ten most clicked items of a user, as a recommender without a model.
VIEWS["popular_recs"] = """
select user_id, news_id, similarity_score, "rank" from (
  select *, row_number() over (partition by user_id order by similarity_score desc, news_id) "rank" from (
    select user_id, split_part(impression, '-', 1) news_id, count(*) / 10.0::double similarity_score
    from shown where suffix(impression, '-1') group by 1, 2)) where "rank" <= 10"""


def popular_recs(spark: SparkSession, folder: str) -> DataFrame:
    from newsweave.operators.behaviors import labelled_items, positives, shown_items
    from newsweave.operators.ranking import top_k

    counted = positives(labelled_items(shown_items(behaviors_train(spark, folder)))).groupBy(
        "user_id", "news_id"
    ).agg((F.count(F.lit(1)) / F.lit(10.0)).alias("similarity_score"))
    return top_k(counted, "user_id", [F.desc("similarity_score"), F.col("news_id")], 10)


def content_profiles(spark: SparkSession, folder: str) -> DataFrame:
    from newsweave.operators.profiles import profiles_from_first_row

    return profiles_from_first_row(behaviors_train(spark, folder), article_vectors(spark, folder))


def content_recs(spark: SparkSession, folder: str) -> DataFrame:
    from newsweave.operators.similarity import top_articles

    return top_articles(content_profiles(spark, folder), article_vectors(spark, folder))


def positions(df: DataFrame, key: str, vector: str) -> DataFrame:
    """A vector column as rows (key, pos from 1, value)."""
    return df.select(key, F.posexplode(vector).alias("_at", "_x")).select(
        key, (F.col("_at") + 1).cast("bigint").alias("pos"), rounded(F.col("_x").cast("double")).alias("value")
    )
