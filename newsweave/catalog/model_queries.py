"""Factor models, clustering, whole jobs and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.catalog.fixtures import (
    article_vectors, behaviors_train, behaviors_valid, news, news_valid, positions, rounded,
    rounded_sql, table, token_vectors, STOP_WORDS,
)
from newsweave.catalog.registry import query
from newsweave.operators import clustering, factorization
from newsweave.operators.behaviors import training_sample, training_samples, truth_pairs
from newsweave.operators.recommendations import factor_ids
from newsweave.operators.vectors import serialised
from newsweave.plans.cluster import cluster_job
from newsweave.plans.collaborative import collaborative_job
from newsweave.plans.content import content_job, content_job_reduced, embed_new_articles
from newsweave.session import cut_lineage, new_folder
from newsweave.sources.tables import ClusterInput, ContentInput, latest_news
from newsweave.streaming.incremental import embed_arriving


def _samples(spark, folder):
    return training_samples(behaviors_train(spark, folder), behaviors_valid(spark, folder))


def _model(spark, folder, **params):
    train, _ = _samples(spark, folder)
    return factorization.als_estimator(**{"rank": 10, "maxIter": 5, **params}).fit(train)


@query("ml2_factor_model")
def factor_model(spark, folder):
    model = _model(spark, folder, maxIter=15)
    return model.userFactors.withColumn("side", F.lit("user")).unionByName(
        model.itemFactors.withColumn("side", F.lit("item"))
    )


@query("ml3_predictions")
def predictions(spark, folder):
    _, valid = _samples(spark, folder)
    return factorization.predictions(_model(spark, folder), valid)


@query("win5_factor_recommendations")
def recommendations(spark, folder):
    return factorization.best_of_users(_model(spark, folder)).drop("blocks")


@query("ml4_convergence")
def convergence(spark, folder):
    return factorization.convergence(*_samples(spark, folder), iterations=3, rank=10)[0]


@query("ml5_grid_search")
def grid(spark, folder):
    train = training_sample(behaviors_train(spark, folder))
    return factorization.grid_search(train, [5, 10], [0.1], [1.0, 5.0], folds=2, maxIter=3)[0]


@query("snk10_src9_ev4_stored_model_evaluated")
def stored_model(spark, folder):
    path = new_folder(spark, "model")
    factorization.save_model(_model(spark, folder), path)
    clicked = factor_ids(truth_pairs(behaviors_valid(spark, folder)), keep_empty=True)
    return factorization.evaluated(spark, path, clicked)


@query("ml7_collaborative_job")
def collaborative(spark, folder):
    result = collaborative_job(
        behaviors_train(spark, folder), behaviors_valid(spark, folder), iterations=2, rank=10,
        output_path=new_folder(spark, "als"),
    )
    return result.flat


@query("jn4_category_of_vectors", """
select a.news_id, coalesce(t.category, 'unknown') category from article_vectors a left join news_train t using (news_id)""")
def category(spark, folder):
    vectors = article_vectors(spark, folder).select("news_id", "embedding")
    return clustering.with_category(vectors, news(spark, folder)).select("news_id", "category")


@query("ml8_centred_components")
def centred(spark, folder):
    found = clustering.centred_pca(article_vectors(spark, folder), 50)[0]
    return found.select("news_id", "pca_embedding")


@query("ml8_plain_components")
def plain(spark, folder):
    return clustering.plain_pca(article_vectors(spark, folder), 32)[0]


@query("ml9_clusters")
def clusters(spark, folder):
    reduced = clustering.centred_pca(article_vectors(spark, folder), 50)[0]
    return clustering.best_kmeans(reduced, starts=3)[0].select("news_id", "category", "cluster")


_BY_LENGTH = "least(floor(log10(n_chars + 1)), 4)"


def _grouped_documents(spark, folder):
    return table(spark, folder, "documents").select(
        F.expr(f"cast({_BY_LENGTH} as int)").alias("cluster"), F.col("lang").alias("category")
    )


@query("agg8_category_counts", f"""
select ({_BY_LENGTH})::integer "cluster", lang category, count(*) "count" from documents group by all""")
def category_counts(spark, folder):
    return clustering.category_counts(_grouped_documents(spark, folder))


@query("agg9_category_table", f"""
select ({_BY_LENGTH})::integer "cluster", count(*) filter (where lang = 'de') de, count(*) filter (where lang = 'en') en,
       count(*) filter (where lang = 'es') es, count(*) filter (where lang = 'fr') fr
from documents group by 1""")
def category_table(spark, folder):
    counts = clustering.category_counts(_grouped_documents(spark, folder))
    # The categories are read from the counts, so that none is left out.
    return clustering.category_table(counts)


@query("fn20_plane", f"""
select news_id, {rounded_sql('embedding[1]')} x, {rounded_sql('embedding[2]')} y, category "cluster" from article_vectors""")
def plane(spark, folder):
    points = article_vectors(spark, folder).withColumn("cluster", F.col("category"))
    found = clustering.plane(points, "embedding")
    return found.select(
        "news_id", rounded(F.col("x").cast("double")).alias("x"), rounded(F.col("y").cast("double")).alias("y"), "cluster"
    )


@query("ml10_cluster_job")
def clustered(spark, folder):
    root = new_folder(spark, "clusters")
    vectors = serialised(article_vectors(spark, folder).select("news_id", "embedding"))
    tables = ClusterInput(vectors, latest_news(news(spark, folder), news_valid(spark, folder)))
    result = cluster_job(
        tables, starts=2, cache_root=f"{root}/cache", output_root=f"{root}/table", counts_path=f"{root}/counts"
    )
    return result.counts


def _content_input(spark, folder):
    return ContentInput(
        serialised(article_vectors(spark, folder).select("news_id", "embedding")),
        behaviors_train(spark, folder), behaviors_valid(spark, folder),
    )


@query("ml11_content_job", f"""
select user_id, news_id, {rounded_sql('similarity_score', 5)} similarity_score, "rank" from content_recs""")
def content(spark, folder):
    found = content_job(_content_input(spark, folder), output_root=new_folder(spark, "content")).recommendations
    return found.select("user_id", "news_id", rounded(F.col("similarity_score"), 5).alias("similarity_score"), "rank")


@query("ml11_content_job_errors", f"""
with l as (
  select similarity_score s, case when (r.user_id, r.news_id) in (select user_id, news_id from truth where news_id is not null)
         then 1 else 0 end label
  from content_recs r where user_id in (select user_id from truth))
select {rounded_sql('avg((label - s) * (label - s))')} mse, {rounded_sql('sqrt(avg((label - s) * (label - s)))')} rmse from l""")
def content_errors(spark, folder):
    found = content_job(_content_input(spark, folder)).errors
    return found.select(rounded(F.col("mse")).alias("mse"), rounded(F.col("rmse")).alias("rmse"))


@query("ml11_content_job_reduced")
def content_reduced(spark, folder):
    return content_job_reduced(_content_input(spark, folder), components=32).recommendations


@query("txt7_embedded_articles_appended", f"select news_id, pos, {rounded_sql('x')} \"value\" from document_values")
def embedded(spark, folder):
    from newsweave.operators.vectors import parsed

    path = new_folder(spark, "vectors")
    articles, vectors = news(spark, folder), token_vectors(spark, folder)
    nothing = spark.createDataFrame([], "news_id string")
    embed_new_articles([news_valid(spark, folder)], nothing, vectors, path, STOP_WORDS)
    embed_new_articles([articles], spark.read.parquet(path), vectors, path, STOP_WORDS)
    whole = parsed(spark.read.parquet(path), kind="double")
    return positions(whole, "news_id", "embedding")


@query("st1_embedded_stream", f"select news_id, pos, {rounded_sql('x')} \"value\" from document_values")
def stream(spark, folder):
    root = new_folder(spark, "stream")
    news(spark, folder).repartition(4, "news_id").write.parquet(f"{root}/articles")
    tokens = token_vectors(spark, folder)
    embed_arriving(
        spark, f"{root}/articles", f"{root}/vectors", tokens, f"{root}/checkpoint", STOP_WORDS, files_per_batch=2
    ).awaitTermination()
    return positions(spark.read.parquet(f"{root}/vectors"), "news_id", "embedding")


# Parts of the models' results that do not depend on the solver, against SQL.


@query("win5_ranks_of_every_user", """
select "userId" user_id, least(10, (select count(distinct "newsId") from samples where part = 'train'))::bigint n,
       1::bigint lowest, least(10, (select count(distinct "newsId") from samples where part = 'train'))::bigint highest
from samples where part = 'train' group by 1""")
def ranks_of_every_user(spark, folder):
    return recommendations(spark, folder).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("lowest"), F.max("rank").alias("highest"))


_TEN = """least(10, (select count(distinct "newsId") from samples where part = 'train'))::bigint"""


@query("win5_equal_to_all_products", f"""
select "userId" user_id, {_TEN} n, 0::bigint differing from samples where part = 'train' group by 1""")
def equal_to_all_products(spark, folder):
    model = _model(spark, folder)
    # Scores are compared place by place, as equal ones may come in another order.
    whole = factorization.flat_recommendations(factorization.recommendations(model)).select(
        "user_id", "rank", F.col("similarity_score").alias("other"))
    both = factorization.best_of_users(model).join(whole, ["user_id", "rank"], "full")
    differs = F.coalesce(F.abs(F.col("similarity_score") - F.col("other")) > 1e-5, F.lit(True))
    return both.groupBy("user_id").agg(F.count("similarity_score").alias("n"), F.count_if(differs).alias("differing"))


@query("ml2_factors_of_every_id", """
select 'user' side, count(distinct "userId") ids, 10::integer lowest, 10::integer highest from samples where part = 'train'
union all select 'item', count(distinct "newsId"), 10::integer, 10::integer from samples where part = 'train'""")
def factors_of_every_id(spark, folder):
    return factor_model(spark, folder).groupBy("side").agg(
        F.count(F.lit(1)).alias("ids"), F.min(F.size("features")).alias("lowest"), F.max(F.size("features")).alias("highest"))


@query("ml3_pairs_and_factor_products", """
select "userId", "newsId", clicked, 0.0::double difference from samples
where part = 'valid' and "userId" in (select "userId" from samples where part = 'train')
  and "newsId" in (select "newsId" from samples where part = 'train')""")
def pairs_and_products(spark, folder):
    _, valid = _samples(spark, folder)
    model = _model(spark, folder)
    users = model.userFactors.select(F.col("id").alias("userId"), F.col("features").alias("u"))
    items = model.itemFactors.select(F.col("id").alias("newsId"), F.col("features").alias("i"))
    scored = factorization.predictions(model, valid).join(users, "userId").join(items, "newsId")
    product = F.aggregate(F.zip_with("u", "i", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return scored.select("userId", "newsId", "clicked", rounded(F.col("prediction") - product, 4).alias("difference"))


@query("ml4_iterations", "select unnest(range(1, 4))::integer iteration, true falls_short_of_one")
def iterations(spark, folder):
    curve = convergence(spark, folder)
    return curve.select("iteration", ((F.col("rmse") > 0) & (F.col("rmse") < 1) & (F.col("mae") <= F.col("rmse"))).alias("falls_short_of_one"))


@query("ml5_grid_points", """
select r::integer "rank", 0.1::double reg_param, a::double alpha from (values (5), (10)) x(r), (values (1.0), (5.0)) y(a)""")
def grid_points(spark, folder):
    return grid(spark, folder).select("rank", "reg_param", "alpha")


@query("ev4_users_evaluated", """
select count(distinct "userId") users from samples
where part = 'train' and "userId" in (select try_cast(regexp_replace(user_id, '^U', '') as integer) from truth)""")
def users_evaluated(spark, folder):
    return stored_model(spark, folder).select("users")


def _scored(model, pairs):
    """The pairs with the product of their factors, worked out anew."""
    users = model.userFactors.select(F.col("id").alias("userId"), F.col("features").alias("u"))
    items = model.itemFactors.select(F.col("id").alias("newsId"), F.col("features").alias("i"))
    product = F.aggregate(F.zip_with("u", "i", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(users, "userId").join(items, "newsId").withColumn("score", product)


@query("ml4_last_error_recomputed", "select 3::integer iteration, 0.0::double rmse_difference, 0.0::double mae_difference")
def last_error(spark, folder):
    train, valid = _samples(spark, folder)
    curve, model = factorization.convergence(train, valid, iterations=3, rank=10)
    error = F.col("clicked") - F.col("score")
    anew = _scored(model, valid).agg(F.sqrt(F.avg(error * error)).alias("r"), F.avg(F.abs(error)).alias("m"))
    return curve.where("iteration = 3").crossJoin(F.broadcast(anew)).select(
        "iteration", rounded(F.col("rmse") - F.col("r"), 4).alias("rmse_difference"), rounded(F.col("mae") - F.col("m"), 4).alias("mae_difference"))


@query("ml5_errors_recomputed", """
select r::integer "rank", 0.1::double reg_param, a::double alpha, 0.0::double difference from (values (5), (10)) x(r), (values (1.0), (5.0)) y(a)""")
def grid_errors(spark, folder):
    train = cut_lineage(training_sample(behaviors_train(spark, folder)))
    table_, _ = factorization.grid_search(train, [5, 10], [0.1], [1.0, 5.0], folds=2, maxIter=3)
    folds = cut_lineage(factorization.with_fold(train, 2, 47))
    rows = []
    for rank in (5, 10):
        for alpha in (1.0, 5.0):
            errors = []
            for fold in range(2):
                model = factorization.als_estimator(rank=rank, regParam=0.1, alpha=alpha, maxIter=3).fit(folds.where(F.col("_fold") != fold).drop("_fold"))
                error = F.col("clicked") - F.col("score")
                errors.append(_scored(model, folds.where(F.col("_fold") == fold)).agg(F.sqrt(F.avg(error * error))).first()[0])
            rows.append((rank, 0.1, alpha, sum(errors) / 2))
    anew = spark.createDataFrame(rows, "rank int, reg_param double, alpha double, anew double")
    return table_.join(anew, ["rank", "reg_param", "alpha"], "full").select(
        "rank", "reg_param", "alpha", rounded(F.col("rmse") - F.col("anew"), 3).alias("difference"))


@query("ev4_metrics_recomputed", """
select count(distinct "userId") users, 0.0::double precision_difference, 0.0::double recall_difference,
       0.0::double ndcg_difference, 0.0::double map_difference
from samples where part = 'train' and "userId" in (select try_cast(regexp_replace(user_id, '^U', '') as integer) from truth)""")
def metrics_recomputed(spark, folder):
    path = new_folder(spark, "model")
    factorization.save_model(_model(spark, folder), path)
    pairs = cut_lineage(factor_ids(truth_pairs(behaviors_valid(spark, folder)), keep_empty=True))
    found = factorization.evaluated(spark, path, pairs)
    # The same once more in plain SQL over the stored model's rows, hit by hit.
    factorization.best_of_users(factorization.load_model(path)).createOrReplaceTempView("_ev4_shown")
    pairs.createOrReplaceTempView("_ev4_truth")
    anew = spark.sql("""
        with truth as (select user_id, count(distinct news_id) relevant from _ev4_truth group by user_id),
        hits as (
          select s.user_id, s.rank, row_number() over (partition by s.user_id order by s.rank) nth
          from _ev4_shown s join (select distinct user_id, news_id from _ev4_truth where news_id is not null) t
            on s.user_id = t.user_id and s.news_id = t.news_id),
        sums as (select user_id, count(*) n, sum(1 / log2(rank + 1)) gain, sum(nth / rank) precisions from hits group by user_id),
        ideal as (select t.user_id, sum(1 / log2(place + 1)) best from truth t lateral view explode(sequence(1, 10)) p as place
                  where place <= t.relevant group by t.user_id),
        each as (
          select coalesce(n, 0) / 10 p, coalesce(n / relevant, 0) r, coalesce(gain / best, 0) g, coalesce(precisions / relevant, 0) a
          from truth left join sums using (user_id) left join ideal using (user_id)
          where user_id in (select user_id from _ev4_shown))
        select count(*) u, avg(p) p, avg(r) r, avg(g) g, avg(a) a from each""")
    return found.crossJoin(F.broadcast(anew)).where("users = u").select(
        "users", rounded(F.col("precision_at_k") - F.col("p")).alias("precision_difference"), rounded(F.col("recall_at_k") - F.col("r")).alias("recall_difference"),
        rounded(F.col("ndcg_at_k") - F.col("g")).alias("ndcg_difference"), rounded(F.col("mean_average_precision") - F.col("a")).alias("map_difference"))


@query("ml9_cheapest_start_chosen", "select 3::bigint starts, true chosen_is_cheapest, 0.0::double difference")
def cheapest_start(spark, folder):
    reduced = cut_lineage(clustering.centred_pca(article_vectors(spark, folder), 50)[0])
    labelled, _, costs = clustering.best_kmeans(reduced, starts=3)
    # Squared distances to the means of the clusters, from the labels alone.
    values = labelled.select("cluster", F.posexplode("pca_embedding").alias("pos", "x"))
    spread = values.groupBy("cluster", "pos").agg((F.count(F.lit(1)) * F.var_pop("x")).alias("s")).agg(F.sum("s").alias("cost"))
    # A centre is the mean of its cluster only once nothing moves any more.
    return spread.select(
        F.lit(len(costs)).cast("bigint").alias("starts"), (F.col("cost") <= min(costs) * (1 + 1e-6)).alias("chosen_is_cheapest"),
        rounded(F.greatest(F.lit(0.0), F.abs(F.col("cost") / min(costs) - 1) - 0.01), 4).alias("difference"))


@query("ml7_users_recommended_to", """select "userId" user_id, 10::bigint n from samples where part = 'train' group by 1""")
def users_recommended_to(spark, folder):
    return collaborative(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("ml8_means_and_total_variance", f"""
select (select count(*) from article_vectors) "rows", 0.0::double largest_mean, {rounded_sql('sum(v)', 5)} total_variance
from (select pos, var_samp(x) v from (
  select unnest(embedding) x, unnest(range(1, len(embedding) + 1)) pos from article_vectors) group by 1)""")
def means_and_variance(spark, folder):
    # With all components the projection only turns the vectors.
    turned = clustering.centred_pca(article_vectors(spark, folder), 64)[0]
    by_place = turned.select("news_id", F.posexplode("pca_embedding").alias("pos", "x")).groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("v"))
    return by_place.agg(
        F.max("n").alias("rows"), rounded(F.max(F.abs("mean"))).alias("largest_mean"), rounded(F.sum("v"), 5).alias("total_variance"))


@query("ml8_lengths_after_rotation", f"""
select news_id, {rounded_sql('sqrt(list_sum(list_transform(embedding, lambda x: x * x)))', 5)} length from article_vectors""")
def lengths_after_rotation(spark, folder):
    turned = clustering.plain_pca(article_vectors(spark, folder), 64)[0]
    squares = F.aggregate(F.transform("embedding_pca", lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    return turned.select("news_id", rounded(F.sqrt(squares), 5).alias("length"))


@query("ml9_categories_of_all_clusters", """
select category, count(*) articles, true in_range from article_vectors group by 1""")
def categories_of_all_clusters(spark, folder):
    return clusters(spark, folder).groupBy("category").agg(
        F.count(F.lit(1)).alias("articles"), ((F.min("cluster") >= 0) & (F.max("cluster") < 3)).alias("in_range"))


@query("ml10_categories_of_all_clusters", """
select coalesce(t.category, 'unknown') category, count(*)::bigint articles
from article_vectors a left join news_train t using (news_id) group by 1""")
def categories_of_the_job(spark, folder):
    return clustered(spark, folder).groupBy("category").agg(F.sum("count").alias("articles"))


@query("ml11_users_of_the_reduced_job", """select user_id, 10::bigint n from train_profiles group by 1""")
def users_of_the_reduced_job(spark, folder):
    return content_reduced(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
