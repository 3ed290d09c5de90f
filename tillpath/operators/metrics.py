"""Classifier metrics as aggregates over scored rows.

Input: one row per (model, customer) with `label` 0/1 and `score` in [0, 1]. All metrics start from
counts per distinct score, so their cost after the first aggregate is that of the distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpath.config import DEFAULTS, Settings
from tillpath.functions.numeric import half_up
from tillpath.operators.ranking import running_totals


def _counts(scored: DataFrame, *extra: str | Column) -> DataFrame:
    positive = F.col("label") == 1
    return scored.groupBy("model", *extra).agg(
        F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives")
    )


def _share(top: Column, bottom: Column, digits: int = 4) -> Column:
    """A share as rounded double; 0 where nothing was counted, as classifier reports have it."""
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return half_up(F.coalesce(value, F.lit(0.0)), digits)


def _cumulated(scored: DataFrame, falling: bool, partitions: int | None) -> DataFrame:
    """Distinct scores per model in order with running and total counts inside the model."""
    score = F.col("score").desc() if falling else F.col("score")
    sums = running_totals(
        _counts(scored, "score"),
        ["model", score],
        {"positives": "positives_upto", "negatives": "negatives_upto"},
        partitions=partitions,
    )
    # One row per model.
    models = sums.groupBy("model").agg(
        F.sum("positives").alias("all_positives"),
        F.sum("negatives").alias("all_negatives"),
        F.min(F.col("positives_upto") - F.col("positives")).alias("positives_start"),
        F.min(F.col("negatives_upto") - F.col("negatives")).alias("negatives_start"),
    )
    return sums.join(F.broadcast(models), "model").select(
        "model",
        "score",
        "positives",
        "negatives",
        (F.col("positives_upto") - F.col("positives_start")).alias("positives_upto"),
        (F.col("negatives_upto") - F.col("negatives_start")).alias("negatives_upto"),
        "all_positives",
        "all_negatives",
    )


def auc(scored: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Exact area under the ROC curve per model: pairs ranked right, ties half."""
    steps = _cumulated(scored, False, partitions)
    below = (F.col("negatives_upto") - F.col("negatives")) * 2 + F.col("negatives")
    pairs = (F.col("positives").cast("decimal(19,0)") * below.cast("decimal(19,0)"))
    return steps.groupBy("model").agg(
        half_up(
            F.try_divide(
                F.sum(pairs).cast("double"),
                2.0 * F.max("all_positives").cast("double") * F.max("all_negatives").cast("double"),
            ),
            4,
        ).alias("auc_roc")
    )


def evaluate_models(
    scored: DataFrame, threshold: float = 0.5, *, partitions: int | None = None
) -> DataFrame:
    """Precision, recall, F1 of class 1, AUC and accuracy per model, best AUC first."""
    predicted = F.col("score") >= threshold
    actual = F.col("label") == 1
    counts = scored.groupBy("model").agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.join(auc(scored, partitions=partitions), "model")
        .select(
            "model",
            _share(tp, tp + fp).alias("precision"),
            _share(tp, tp + fn).alias("recall"),
            _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
            "auc_roc",
            _share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        )
        .orderBy(F.col("auc_roc").desc(), "model")
    )


def best_model(comparison: DataFrame) -> DataFrame:
    """The model with the highest AUC; the first by name among equals."""
    return comparison.orderBy(F.col("auc_roc").desc(), "model").limit(1)


# Thresholds in hundredths: 0.10, 0.11, ... 0.89.
_FIRST, _LAST = 10, 89


def threshold_costs(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Cost, errors and quality of every threshold, per model.

    A score passes every threshold up to its hundredths, so rows are counted per hundredth and the
    counts are summed from the top: at most 101 rows per model after the first aggregate.
    """
    # The product may round up to the next bound, so it is compared with the score itself.
    product = F.floor(F.col("score") * 100).cast("int")
    hundredth = (
        F.when(F.col("score") < product / F.lit(100.0), product - 1)
        .when(F.col("score") >= (product + 1) / F.lit(100.0), product + 1)
        .otherwise(product)
    )
    buckets = _counts(scored, hundredth.alias("bucket"))
    top_down = Window.partitionBy("model").orderBy(F.col("bucket").desc())
    whole = Window.partitionBy("model")
    grid = (
        scored.sparkSession.range(0, 101)
        .select(F.col("id").cast("int").alias("bucket"))
        .crossJoin(buckets.select("model").distinct())
    )
    sums = grid.join(buckets, ["model", "bucket"], "left").select(
        "model",
        "bucket",
        F.sum(F.coalesce("positives", F.lit(0))).over(top_down).alias("tp"),
        F.sum(F.coalesce("negatives", F.lit(0))).over(top_down).alias("fp"),
        F.sum(F.coalesce("positives", F.lit(0))).over(whole).alias("all_positives"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("all_positives") - tp
    return sums.where(F.col("bucket").between(_FIRST, _LAST)).select(
        "model",
        (F.col("bucket") / 100.0).alias("threshold"),
        (fp * settings.cost_fp + fn * settings.cost_fn).alias("cost"),
        fp.alias("fp"),
        fn.alias("fn"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, F.col("all_positives")).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def threshold_sweep(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The cheapest threshold per model; the lowest one among equals."""
    costs = threshold_costs(scored, settings)
    row = F.struct(*[c for c in costs.columns if c != "model"])
    return costs.groupBy("model").agg(F.min_by(row, F.struct("cost", "threshold")).alias("best")).select(
        "model", "best.*"
    )


def roc_points(scored: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """False and true positive rate at every distinct score."""
    steps = _cumulated(scored, True, partitions)
    return steps.select(
        "model",
        F.col("score").alias("threshold"),
        F.try_divide(
            F.col("negatives_upto").cast("double"), F.col("all_negatives").cast("double")
        ).alias("fpr"),
        F.try_divide(
            F.col("positives_upto").cast("double"), F.col("all_positives").cast("double")
        ).alias("tpr"),
    )


def confusion_matrix(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows: model and actual class; columns: predicted class."""
    predicted = (F.col("score") >= threshold).cast("int")
    return (
        scored.select("model", F.col("label").cast("int").alias("actual"), predicted.alias("predicted"))
        .groupBy("model", "actual")
        .pivot("predicted", [0, 1])
        .count()
        .na.fill(0)
        .withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"})
    )
