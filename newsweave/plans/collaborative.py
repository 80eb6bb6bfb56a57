"""The collaborative job: click logs to factor-model recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame

from newsweave.constants import ALS_PARAMS, NPRATIO, TOP_K
from newsweave.operators.behaviors import training_samples
from newsweave.operators.factorization import (
    convergence, flat_recommendations, predictions, recommendations, save_model,
)
from newsweave.operators.evaluation import regression_metrics
from newsweave.session import cut_lineage
from newsweave.sinks.writers import append
from newsweave.sources.tables import require_ready


@dataclass(frozen=True)
class CollaborativeResult:
    model: ALSModel
    curve: DataFrame
    metrics: DataFrame
    recommendations: DataFrame

    @property
    def flat(self) -> DataFrame:
        return flat_recommendations(self.recommendations)


def collaborative_job(
    train: DataFrame,
    valid: DataFrame,
    k: int = TOP_K,
    npratio: int = NPRATIO,
    iterations: int = ALS_PARAMS["maxIter"],
    model_path: str | None = None,
    output_path: str | None = None,
    **params,
) -> CollaborativeResult:
    """Check the inputs, sample, fit with a convergence curve, score the
    validation sample, recommend, and store model and recommendations."""
    require_ready({"behaviors_train": train, "behaviors_valid": valid}, "impression_id")
    # Fits and metrics all read the samples.
    train_sample, valid_sample = (cut_lineage(x) for x in training_samples(train, valid, npratio))
    curve, model = convergence(train_sample, valid_sample, iterations, **params)
    metrics = regression_metrics(predictions(model, valid_sample))
    nested = recommendations(model, k)
    if model_path:
        save_model(model, model_path)
    if output_path:
        append(nested, output_path)
    return CollaborativeResult(model, curve, metrics, nested)
