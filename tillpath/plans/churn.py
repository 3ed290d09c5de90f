"""Churn models: train, compare, pick, score every customer, merge the scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from tillpath.config import DEFAULTS, Settings
from tillpath.operators import classifiers, metrics
from tillpath.operators.features import churn_features, product_diversity
from tillpath.operators.merging import fill_features, merge_scores
from tillpath.schemas import Star
from tillpath.session import cut


@dataclass(frozen=True)
class ChurnResult:
    best: str
    comparison: DataFrame
    importance: DataFrame
    threshold: DataFrame
    predictions: DataFrame
    scores: DataFrame
    feature_table: DataFrame


def run_churn(
    star: Star,
    table: DataFrame,
    settings: Settings = DEFAULTS,
    *,
    models: tuple[str, ...] = classifiers.MODELS,
    rounds: int = 200,
) -> ChurnResult:
    """`table` is the customer feature table of the segmentation job."""
    spark = star.fact.sparkSession
    features = cut(churn_features(star.fact, star.dates, star.customers, table, settings))
    data = classifiers.prepare(features, settings)
    fitted = {name: classifiers.fit_model(name, data, settings, rounds=rounds) for name in models}
    predictions = cut(reduce(
        DataFrame.unionByName,
        [classifiers.predict(name, model, data.test) for name, model in fitted.items()],
    ))
    comparison = cut(metrics.evaluate_models(predictions))
    best = metrics.best_model(comparison).first()["model"]
    scores = classifiers.score_all(features, fitted[best], data.encoder, settings)
    filled = fill_features(table, features, product_diversity(star.fact))
    return ChurnResult(
        best=best,
        comparison=comparison,
        importance=classifiers.feature_importance(fitted[best], spark),
        threshold=metrics.threshold_sweep(predictions, settings).where(f"model = '{best}'"),
        predictions=predictions,
        scores=scores,
        feature_table=merge_scores(filled, scores),
    )
