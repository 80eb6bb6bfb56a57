"""The content-based job: articles and click logs to recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from newsweave.constants import CONTENT_PCA_COMPONENTS, TOP_K
from newsweave.operators.behaviors import truth_pairs
from newsweave.operators.clustering import plain_pca
from newsweave.operators.evaluation import mean_ranking_metrics, ranking_metrics, similarity_errors
from newsweave.operators.profiles import profiles_from_all_rows, profiles_from_first_row
from newsweave.operators.similarity import load_or_build_cells, search_approximate, top_articles
from newsweave.operators.text_vectors import new_document_vectors
from newsweave.operators.vectors import parsed_checked, serialised
from newsweave.session import cut_lineage, stored
from newsweave.sinks.writers import append, upsert_recommendations
from newsweave.sources.tables import ContentInput, latest_news


@dataclass(frozen=True)
class ContentResult:
    profiles: DataFrame
    recommendations: DataFrame
    errors: DataFrame
    ranking: DataFrame


def embed_new_articles(
    news: Sequence[DataFrame],
    done: DataFrame,
    token_vectors: DataFrame,
    path: str | None = None,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """Vectors, in text form, of the articles in ``news`` that ``done`` lacks;
    appended to ``path`` if given. A later table wins over an earlier one."""
    vectors = serialised(new_document_vectors(latest_news(*news), done, token_vectors, stop_words))
    if path:
        # Written out before the append, as ``done`` may be the same table.
        vectors = stored(vectors, "vectors")
        append(vectors, path)
    return vectors


def content_job(
    tables: ContentInput,
    k: int = TOP_K,
    first_row_only: bool = True,
    pca_components: int | None = None,
    index_path: str | None = None,
    probes: int = 1,
    output_root: str | None = None,
) -> ContentResult:
    """Parse the vectors, optionally reduce them, average them into profiles,
    search, store, and evaluate against the validation log. With
    ``index_path`` the search is approximate over a stored index."""
    articles = tables.embeddings
    if "embedding_string" in articles.columns:
        # Parsed once; the check, the reduction, the profiles and the search read it.
        articles = cut_lineage(parsed_checked(articles).select("news_id", "embedding"))
    articles = articles.select("news_id", "embedding")
    if pca_components:
        reduced, _ = plain_pca(articles, pca_components)
        articles = reduced.withColumnRenamed("embedding_pca", "embedding")
    build = profiles_from_first_row if first_row_only else profiles_from_all_rows
    profiles = build(tables.train, articles)
    if index_path:
        found = search_approximate(profiles, load_or_build_cells(articles, index_path), k, probes)
    else:
        found = top_articles(profiles, articles, k)
    if output_root:
        # The stored rows are what the evaluation reads.
        stored = upsert_recommendations(found, output_root)
        found = stored.select(F.col("userId").alias("user_id"), F.inline("recommendations")).select(
            "user_id", F.col("newsId").alias("news_id"), F.col("rating").alias("similarity_score"), "rank"
        )
    else:
        # The search would otherwise run once per metric.
        found = cut_lineage(found)
    truth = truth_pairs(tables.valid)
    return ContentResult(
        profiles, found, similarity_errors(found, truth),
        mean_ranking_metrics(ranking_metrics(found, truth, k)),
    )


def content_job_reduced(tables: ContentInput, k: int = TOP_K, components: int = CONTENT_PCA_COMPONENTS) -> ContentResult:
    """The variant over reduced vectors and all history rows."""
    return content_job(tables, k, first_row_only=False, pca_components=components)
