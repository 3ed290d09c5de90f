"""The three churn classifiers as MLlib pipelines."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tillpath.config import DEFAULTS, Settings
from tillpath.fixed_values import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from tillpath.functions.numeric import half_up, risk_tier
from tillpath.operators.features import fit_encoder, impute, stratified_split
from tillpath.session import shared_folder, stage

INPUTS = [*NUMERIC_FEATURES, *[f"{c}_enc" for c in CATEGORICAL_FEATURES]]
MODELS = ("logistic_regression", "random_forest", "boosted_trees")


@dataclass(frozen=True)
class TrainingData:
    """Encoded customers with `is_test` and `label`, staged so that every fit reads the same rows."""

    rows: DataFrame
    encoder: Model

    @property
    def train(self) -> DataFrame:
        return self.rows.where(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.rows.where("is_test")


def prepare(features: DataFrame, settings: Settings = DEFAULTS) -> TrainingData:
    """Impute, encode and split. The encoder sees all rows, as the categories are closed lists.

    The features come from all lines, and the encoder, the bounds of the split and its rows each go
    through them; so they are staged first.
    """
    used = ["customer_id", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, "churn_label"]
    complete = stage(impute(features).select(*used), "features")
    encoder = fit_encoder(complete)
    split = stratified_split(encoder.transform(complete), settings)
    labelled = split.select(
        "customer_id", *INPUTS, "is_test", F.col("churn_label").cast("double").alias("label")
    )
    return TrainingData(stage(labelled, "training"), encoder)


def _classifier(name: str, n_train: int, settings: Settings, rounds: int):
    columns = {"featuresCol": "features", "labelCol": "label", "seed": settings.seed}
    if name == "logistic_regression":
        # MLlib averages the loss over rows, so a penalty of 1 on the sum is 1/n here.
        return LogisticRegression(
            featuresCol="features", labelCol="label", maxIter=1000, regParam=1.0 / max(n_train, 1),
            standardization=False,
        )
    if name == "random_forest":
        return RandomForestClassifier(
            numTrees=rounds, maxDepth=10, minInstancesPerNode=20, cacheNodeIds=True, **columns
        )
    if name == "boosted_trees":
        return GBTClassifier(
            maxIter=rounds, maxDepth=6, stepSize=0.1, minInstancesPerNode=20, **columns
        )
    raise ValueError(f"unknown model {name!r}")


def fit_model(
    name: str, data: TrainingData, settings: Settings = DEFAULTS, *, rounds: int = 200
) -> PipelineModel:
    """Assemble, scale on the training rows, fit. `rounds` is the number of trees.

    The fitted pipeline is saved to the shared folder and loaded again. Scoring then depends on the
    stored model only: a fresh fit also carries its training summary, which holds on to the session
    and stops the model from being sent to executors once the session has observed a metric.
    """
    train = data.train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = Pipeline(stages=[
            VectorAssembler(inputCols=INPUTS, outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
            _classifier(name, train.count(), settings, rounds),
        ]).fit(train)
    finally:
        train.unpersist()
    path = os.path.join(shared_folder(data.rows.sparkSession), f"model-{uuid.uuid4().hex}")
    fitted.write().save(path)
    return PipelineModel.load(path)


def predict(name: str, model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(model, customer_id, label, score) with the probability of class 1."""
    scored = model.transform(rows)
    return scored.select(
        F.lit(name).alias("model"),
        "customer_id",
        *(["label"] if "label" in rows.columns else []),
        vector_to_array("probability")[1].alias("score"),
    )


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """Tree importances or absolute coefficients, one row per input, largest first."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        weights = last.featureImportances.toArray()
    else:
        weights = abs(last.coefficients.toArray())
    rows = [(name, float(w)) for name, w in zip(INPUTS, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def score_all(
    features: DataFrame, model: PipelineModel, encoder: Model, settings: Settings = DEFAULTS
) -> DataFrame:
    """Score every customer in one map-side pass. Observed and predicted label stay apart."""
    scored = model.transform(encoder.transform(impute(features)))
    score = vector_to_array("probability")[1]
    return scored.select(
        "customer_id",
        half_up(score, 4).alias("churn_probability"),
        F.col("churn_label").alias("churn_observed"),
        (score >= 0.5).alias("churn_predicted"),
        risk_tier(score, settings).alias("risk_tier"),
    )
