"""Monthly revenue of many series at once, as (series_key, month, value).

A series has one row per calendar month, so everything after the first aggregate is bounded by
months x series; windows and grouped maps are per series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpath.config import DEFAULTS, Settings
from tillpath.functions.numeric import half_up
from tillpath.operators.orders import MONEY, money, sales, with_calendar

ALL = "all"
PERIOD = 12


def monthly_series(fact: DataFrame, dates: DataFrame, key: Column | None = None) -> DataFrame:
    """Revenue over sale lines per key and month; one series `all` without a key.

    `key` is a column expression on the fact, e.g. the country after a join with the customers.
    """
    lines = with_calendar(sales(fact), dates, "full_date")
    name = F.lit(ALL) if key is None else key.cast("string")
    return lines.groupBy(
        name.alias("series_key"), F.trunc("full_date", "MM").alias("month")
    ).agg(money(F.sum("total_amount")).alias("value"))


def series_by_country(fact: DataFrame, dates: DataFrame, customers: DataFrame) -> DataFrame:
    """One series per country.

    Lines are merged per customer and month before the customer lookup, so a customer with many
    lines is one row per month in the join.
    """
    merged = (
        with_calendar(sales(fact), dates, "full_date")
        .groupBy("customer_id", F.trunc("full_date", "MM").alias("month"))
        .agg(F.sum("total_amount").alias("amount"))
    )
    return (
        merged.join(customers.select("customer_id", "country"), "customer_id")
        .groupBy(F.col("country").alias("series_key"), "month")
        .agg(money(F.sum("amount")).alias("value"))
    )


def drop_truncated_month(series: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Drop a series' last month if it is under half the mean of its other months."""
    whole = Window.partitionBy("series_key")
    marked = series.withColumn("_is_last", F.col("month") == F.max("month").over(whole))
    others = F.when(~F.col("_is_last"), F.col("value"))
    mean = F.try_divide(
        F.sum(others).over(whole).cast("double"), F.count(others).over(whole).cast("double")
    )
    low = F.col("value").cast("double") < F.col("_mean") * settings.truncated_below
    return (
        marked.withColumn("_mean", mean)
        .where(~F.coalesce(F.col("_is_last") & low, F.lit(False)))
        .drop("_is_last", "_mean")
    )


def regular_grid(series: DataFrame) -> DataFrame:
    """Every month from first to last per series; a month without data is NULL and `is_gap`."""
    span = series.groupBy("series_key").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = span.select(
        "series_key", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month")
    )
    return months.join(series, ["series_key", "month"], "left").withColumn(
        "is_gap", F.col("value").isNull()
    )


def decompose(series: DataFrame) -> DataFrame:
    """Additive decomposition with period 12, for series of 24 months or more.

    Trend is the centred 2x12 moving average, empty for six months at either end and next to a
    gap. The moving sum is a decimal sum, so the trend does not depend on the order of additions.
    """
    ordered = Window.partitionBy("series_key").orderBy("month")
    whole = Window.partitionBy("series_key")
    value = F.col("value").cast(MONEY)
    inner = F.sum(value).over(ordered.rowsBetween(-5, 5))
    complete = F.count(value).over(ordered.rowsBetween(-5, 5)) == 11
    outer = F.lag(value, 6).over(ordered) + F.lead(value, 6).over(ordered)
    long_enough = series.withColumn("_n", F.count("value").over(whole)).where(
        F.col("_n") >= 2 * PERIOD
    )
    trended = long_enough.select(
        "series_key",
        "month",
        F.col("value").cast("double").alias("observed"),
        F.when(complete, (inner * 2 + outer).cast("double") / (2.0 * PERIOD)).alias("trend"),
    )
    by_phase = Window.partitionBy("series_key", F.month("month"))
    phased = trended.withColumn(
        "_phase_mean", F.avg(F.col("observed") - F.col("trend")).over(by_phase)
    )
    # The twelve phase means are centred on zero; each month of the year counts once.
    phases = (
        phased.groupBy("series_key", F.month("month").alias("_phase"))
        .agg(F.first("_phase_mean").alias("_mean"))
        .groupBy("series_key")
        .agg(F.avg("_mean").alias("_level"))
    )
    seasonal = F.col("_phase_mean") - F.col("_level")
    return phased.join(phases, "series_key").select(
        "series_key",
        "month",
        "observed",
        "trend",
        seasonal.alias("seasonal"),
        (F.col("observed") - F.col("trend") - seasonal).alias("residual"),
    )


def anomalies(decomposed: DataFrame, reach: float = 1.5) -> DataFrame:
    """Months whose residual lies beyond the quartiles by `reach` times their distance.

    The exact percentile gathers one series' months, which the calendar bounds.
    """
    quartiles = decomposed.groupBy("series_key").agg(
        F.percentile("residual", F.array(F.lit(0.25), F.lit(0.75))).alias("q")
    ).select("series_key", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    margin = (F.col("q3") - F.col("q1")) * reach
    residual = F.col("residual")
    kind = (
        F.when(residual > F.col("q3") + margin, "spike")
        .when(residual < F.col("q1") - margin, "drop")
        .otherwise("normal")
    )
    return decomposed.join(quartiles, "series_key").select(
        "series_key",
        "month",
        F.col("observed").alias("value"),
        "residual",
        (kind != "normal").alias("is_anomaly"),
        kind.alias("anomaly_type"),
    )


def walk_forward_folds(series: DataFrame, folds: int = DEFAULTS.folds) -> DataFrame:
    """Expanding folds: rows of fold i are its training months and the one month to predict.

    A series of n months has its test month of fold i at position n - folds + i. Every row is
    copied into the folds that contain it.
    """
    ordered = Window.partitionBy("series_key").orderBy("month")
    whole = Window.partitionBy("series_key")
    placed = series.withColumn("_at", F.row_number().over(ordered) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(whole)
    )
    test_at = F.col("_n") - F.lit(folds) + F.col("fold")
    return (
        placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .where((test_at > 0) & (F.col("_at") <= test_at))
        .select("series_key", "fold", "month", "value", (F.col("_at") == test_at).alias("is_test"))
    )


def baseline_forecasts(series: DataFrame, folds: int = DEFAULTS.folds) -> DataFrame:
    """One-step forecasts of three plain rules over the folds.

    `naive`: last month; `seasonal_naive`: same month a year ago; `drift`: last month plus the mean
    monthly change so far. The same rows the folds would give, read off by position.
    """
    ordered = Window.partitionBy("series_key").orderBy("month")
    whole = Window.partitionBy("series_key")
    value = F.col("value").cast("double")
    placed = series.select(
        "series_key",
        "month",
        value.alias("actual"),
        (F.row_number().over(ordered) - 1).alias("_at"),
        F.count(F.lit(1)).over(whole).alias("_n"),
        F.lag(value, 1).over(ordered).alias("_last"),
        F.lag(value, PERIOD).over(ordered).alias("_year_ago"),
        F.first(value).over(ordered).alias("_first"),
    )
    steps = F.col("_at") - 1
    drift = F.col("_last") + F.coalesce(
        F.try_divide(F.col("_last") - F.col("_first"), steps.cast("double")), F.lit(0.0)
    )
    models = F.array(
        F.struct(F.lit("naive").alias("model"), F.col("_last").alias("predicted")),
        F.struct(F.lit("seasonal_naive").alias("model"), F.col("_year_ago").alias("predicted")),
        F.struct(F.lit("drift").alias("model"), drift.alias("predicted")),
    )
    fold = (F.col("_at") - (F.col("_n") - folds)).cast("int")
    return (
        placed.where((fold >= 0) & (F.col("_at") > 0))
        .select("series_key", fold.alias("fold"), "month", "actual", F.inline(models))
        .where(F.col("predicted").isNotNull())
        .select("series_key", "model", "fold", "month", "actual", "predicted")
    )


def forecast_scores(predictions: DataFrame) -> DataFrame:
    """MAPE in percent and RMSE per series and model over the folds, lowest MAPE first.

    A fold without a prediction is in no error; `folds_scored` tells how many folds are.
    """
    error = F.col("predicted") - F.col("actual")
    share = F.try_divide(F.abs(error), F.abs("actual"))
    return (
        predictions.where(F.col("predicted").isNotNull())
        .groupBy("series_key", "model")
        .agg(
            half_up(F.avg(share) * 100.0).alias("mape"),
            half_up(F.sqrt(F.avg(error * error))).alias("rmse"),
            F.countDistinct("fold").alias("folds_scored"),
        )
        .orderBy("series_key", "mape", "model")
    )


def best_forecaster(scores: DataFrame) -> DataFrame:
    """The model with the lowest MAPE per series; the first by name among equals.

    Only models that were scored on as many folds as any model of the series compete.
    """
    place = F.struct((-F.col("folds_scored")).alias("fewer"), "mape", "model")
    best = scores.groupBy("series_key").agg(F.min(place).alias("best"))
    return best.select("series_key", "best.model", "best.mape")
