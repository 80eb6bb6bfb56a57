"""Sources and sinks, each read back after it was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsweave.catalog.fixtures import (
    article_vectors, behaviors_train, behaviors_valid, content_recs, news, news_valid, popular_recs, table,
)
from newsweave.catalog.registry import query
from newsweave.constants import BEHAVIOR_COLUMNS, NEWS_COLUMNS
from newsweave.operators.recommendations import un_nested
from newsweave.operators.vectors import serialised
from newsweave.plans.ingest import load_click_data, load_crawled
from newsweave.session import new_folder
from newsweave.sinks import writers
from newsweave.sinks.versions import read_current
from newsweave.sources import tables


def _write_lines(df: DataFrame, path: str, columns: list[str]) -> None:
    """A tab-separated file without quoting; null is an empty field."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    df.select(F.concat_ws("\t", *fields)).write.text(path)


def _flat_news(spark, folder):
    """Articles whose text holds no field or line separator. ``NA`` stands for
    a missing abstract."""
    one_line = lambda c: F.regexp_replace(c, "[\\t\\r\\n]", " ").alias(c)
    return news(spark, folder).select(
        "news_id", "category", "subcategory", one_line("title"),
        F.coalesce(F.regexp_replace("abstract", "[\\t\\r\\n]", " "), F.lit("NA")).alias("abstract"),
        "url", "title_entities", "text_entities",
    )


_FLAT_NEWS = r"""
select news_id, category, subcategory, nullif(nullif(regexp_replace(title, '[\t\r\n]', ' ', 'g'), ''), 'NA') title,
       nullif(nullif(regexp_replace(abstract, '[\t\r\n]', ' ', 'g'), ''), 'NA') abstract, url, title_entities, text_entities
from news_train"""


@query("src1_table_scan", 'select event_id, user_id, event_type, "value" from events')
def table_scan(spark, folder):
    return tables.read_table(spark, f"{folder}/events.parquet").select("event_id", "user_id", "event_type", "value")


@query("src2_behaviors_file", 'select impression_id, user_id, "time", history, impressions from behaviors_train')
def behaviors_file(spark, folder):
    path = new_folder(spark, "behaviors")
    _write_lines(behaviors_train(spark, folder), path, BEHAVIOR_COLUMNS)
    return tables.read_behaviors(spark, path)


@query("src3_news_file", _FLAT_NEWS)
def news_file(spark, folder):
    path = new_folder(spark, "news")
    _write_lines(_flat_news(spark, folder), path, NEWS_COLUMNS)
    return tables.read_news(spark, path, null_tokens=["NA"])


@query("src4_json_arrays", """
select page_id::varchar _id, url link, html summary, null::varchar title, null::varchar author,
       null::varchar excerpt, null::varchar published_date
from pages""")
def json_arrays(spark, folder):
    path = new_folder(spark, "crawl")
    # Files of one array each, of at most 1000 pages.
    pages = table(spark, folder, "pages").select(
        F.expr("page_id div 1000").alias("file"),
        F.struct(F.col("page_id").cast("string").alias("_id"), F.col("url").alias("link"), F.col("html").alias("summary"))
        .alias("page"),
    )
    arrays = pages.groupBy("file").agg(F.to_json(F.collect_list("page")).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    return tables.read_articles(spark, path)


@query("src5_content_input", """
select 'embeddings' part, count(*) "rows", min(news_id) lowest from article_vectors
union all select 'train', count(*), min(user_id) from behaviors_train
union all select 'valid', count(*), min(user_id) from behaviors_valid""")
def content_input(spark, folder):
    root = new_folder(spark, "content")
    parts = {
        "embeddings": (article_vectors(spark, folder), "news_id"),
        "train": (behaviors_train(spark, folder), "user_id"), "valid": (behaviors_valid(spark, folder), "user_id"),
    }
    for name, (df, _) in parts.items():
        writers.append(df, f"{root}/{name}")
    bundle = tables.read_content_input(spark, *[f"{root}/{name}" for name in parts])
    rows = [
        getattr(bundle, name).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("lowest"))
        .withColumn("part", F.lit(name))
        for name, (_, key) in parts.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("src6_cluster_input", """
select news_id, coalesce(v.subcategory, t.subcategory) subcategory, a.category is not null has_vector
from news_train t left join news_valid v using (news_id) left join article_vectors a using (news_id)""")
def cluster_input(spark, folder):
    root = new_folder(spark, "cluster")
    writers.append(serialised(article_vectors(spark, folder)), f"{root}/vectors")
    writers.append(news(spark, folder), f"{root}/train")
    writers.append(news_valid(spark, folder), f"{root}/valid")
    bundle = tables.read_cluster_input(spark, f"{root}/vectors", [f"{root}/train", f"{root}/valid"])
    known = bundle.embeddings.select("news_id", F.lit(True).alias("known"))
    return bundle.news.join(known, "news_id", "left").select(
        "news_id", "subcategory", F.col("known").isNotNull().alias("has_vector")
    )


@query("src8_readiness", """
select 'documents' table_name, count(doc_id) > 0 ready from documents
union all select 'labels', count(doc_id) > 0 from labels
union all select 'without_rows', count(doc_id) > 0 from documents where lang = 'none'
union all select 'without_field', false""")
def readiness(spark, folder):
    documents = table(spark, folder, "documents")
    return tables.readiness(
        {
            "documents": documents, "labels": table(spark, folder, "labels"),
            "without_rows": documents.filter("lang = 'none'"), "without_field": table(spark, folder, "events"),
        },
        "doc_id",
    )


@query("snk1_append", "select event_id, user_id, event_type from events")
def append(spark, folder):
    path = new_folder(spark, "append")
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    writers.append(events.filter("event_type = 'click'"), path)
    writers.append(events.filter("event_type <> 'click'"), path)
    return tables.read_table(spark, path)


@query("snk2_load_if_empty", "select doc_id, lang from documents")
def load_if_empty(spark, folder):
    path = new_folder(spark, "load")
    documents = table(spark, folder, "documents").select("doc_id", "lang")
    writers.load_if_empty(documents, path)
    writers.load_if_empty(documents, path)
    return tables.read_table(spark, path)


@query("snk3_load_plan", """
select 'events' table_name, count(*) "rows", 500::bigint threshold, case when count(*) > 500 then 'skip' else 'load' end "action"
from events union all
select 'nation', count(*), 25::bigint, case when count(*) > 25 then 'skip' else 'load' end from nation""")
def load_plan(spark, folder):
    return writers.load_plan(
        {name: table(spark, folder, name) for name in ("events", "nation")}, {"events": 500, "nation": 25}
    )


@query("snk3_loaded_click_data", """
select 'behaviors_train' table_name, count(*) "rows" from behaviors_train union all
select 'news_train', count(*) from news_train""")
def loaded(spark, folder):
    root = new_folder(spark, "ingest")
    files = {"behaviors_train": f"{root}/files/behaviors", "news_train": f"{root}/files/news"}
    _write_lines(behaviors_train(spark, folder), files["behaviors_train"], BEHAVIOR_COLUMNS)
    _write_lines(_flat_news(spark, folder), files["news_train"], NEWS_COLUMNS)
    load_click_data(spark, files, f"{root}/tables")
    # A second run leaves what is there.
    load_click_data(spark, files, f"{root}/tables")
    rows = [
        spark.read.parquet(f"{root}/tables/{name}").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("table_name", F.lit(name)) for name in files
    ]
    return rows[0].unionByName(rows[1])


@query("snk4_upsert", """
select coalesce(t.news_id, s.news_id) news_id, coalesce(s.category, t.category) category, t.title,
       s.quality quality
from news_train t full join (
  select news_id, 'labelled' category, subcategory quality from news_valid union all
  select 'B' || item_id, 'benchmark', null from benchmark) s using (news_id)""")
def upsert(spark, folder):
    root = new_folder(spark, "upsert")
    writers.upsert(news(spark, folder).select("news_id", "category", "title"), root, "news_id")
    labelled = news_valid(spark, folder).select(
        "news_id", F.lit("labelled").alias("category"), F.col("subcategory").alias("quality")
    )
    added = table(spark, folder, "benchmark").select(
        F.concat(F.lit("B"), F.col("item_id")).alias("news_id"), F.lit("benchmark").alias("category"),
        F.lit(None).cast("string").alias("quality"),
    )
    source = labelled.unionByName(added)
    writers.upsert(source, root, "news_id")
    # Once more: the table stays the same.
    return writers.upsert(source, root, "news_id")


@query("snk5_upserted_recommendations", """
select user_id "userId", news_id "newsId", "rank" from content_recs union all
select user_id, news_id, "rank" from popular_recs where user_id not in (select user_id from content_recs)""")
def upserted(spark, folder):
    root = new_folder(spark, "recommendations")
    writers.upsert_recommendations(popular_recs(spark, folder), root)
    writers.upsert_recommendations(content_recs(spark, folder), root)
    return un_nested(read_current(spark, root)).select("userId", "newsId", "rank")


@query("snk6_key_violations", 'select conv_id, count(*) "rows" from conversations group by 1 having count(*) > 1')
def violations(spark, folder):
    return writers.key_violations(table(spark, folder, "conversations"), "conv_id")


def _turns(spark, folder):
    return table(spark, folder, "conversations").select(
        F.when(F.col("role") != "system", F.col("conv_id")).alias("conv_id"), "turn", "role"
    )


_TURNS = """
turns as (select case when role <> 'system' then conv_id end conv_id, turn, role from conversations),
numbered as (select *, row_number() over (partition by conv_id order by turn, role) n from turns)"""


@query("snk7_accepted_rows", f"with {_TURNS.strip()} select conv_id, turn, role from numbered where conv_id is not null and n = 1")
def accepted(spark, folder):
    path = new_folder(spark, "insert")
    writers.insert_past_errors(_turns(spark, folder), path, "conv_id", ["turn", "role"])
    writers.insert_past_errors(_turns(spark, folder), path, "conv_id", ["turn", "role"])
    return spark.read.parquet(path)


@query("snk7_rejected_rows", f"""
with {_TURNS.strip()}
select 1::integer run, conv_id, turn, role, case when conv_id is null then 'null key' else 'repeated key' end reason
from numbered where conv_id is null or n > 1
union all
select 2::integer, conv_id, turn, role, case when conv_id is null then 'null key' else 'existing key' end from turns""")
def rejected(spark, folder):
    path = new_folder(spark, "insert")
    first = writers.insert_past_errors(_turns(spark, folder), path, "conv_id", ["turn", "role"])
    second = writers.insert_past_errors(_turns(spark, folder), path, "conv_id", ["turn", "role"])
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))


@query("snk7_loaded_crawl", """
select page_id::varchar _id, url link, html summary from pages union all
select 'B' || item_id, null, "text" from benchmark""")
def loaded_crawl(spark, folder):
    path = new_folder(spark, "crawled")
    pages = table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("_id"), F.col("url").alias("title"), F.col("url").alias("link"),
        F.col("html").alias("summary"),
    )
    items = table(spark, folder, "benchmark").select(
        F.concat(F.lit("B"), F.col("item_id")).alias("_id"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("link"), F.col("text").alias("summary"),
    )
    load_crawled(pages, items.unionByName(pages), path)
    return spark.read.parquet(path).select("_id", "link", "summary")


@query("snk8_json_lines", "select doc_id, \"text\", lang from documents")
def json_lines(spark, folder):
    path = new_folder(spark, "json")
    writers.write_json(table(spark, folder, "documents").select("doc_id", "text", "lang"), path)
    return spark.read.json(path, schema="doc_id bigint, text string, lang string")


@query("snk9_csv", "select source, lang, count(*) n from documents group by all")
def csv(spark, folder):
    path = new_folder(spark, "csv")
    counts = table(spark, folder, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    writers.write_csv(counts, path)
    return spark.read.csv(path, header=True, schema="source string, lang string, n bigint")


@query("snk11_appended_recommendations", """
select user_id "userId", news_id "newsId", similarity_score rating, "rank" from popular_recs""")
def appended(spark, folder):
    path = new_folder(spark, "nested")
    writers.append_recommendations(popular_recs(spark, folder), path)
    return un_nested(spark.read.parquet(path))
