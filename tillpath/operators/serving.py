"""The queries behind the dashboard views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpath.config import DEFAULTS, Settings
from tillpath.functions.numeric import half_up, percent, ratio, risk_tier
from tillpath.functions.text import readable_feature
from tillpath.operators.orders import money, sold


def kpi_summary(fact: DataFrame, features: DataFrame) -> DataFrame:
    """Revenue, customers, orders, order value and churn rate in one row."""
    merged = fact.groupBy("customer_id", "invoice_no").agg(
        money(F.sum(sold("total_amount"))).alias("amount"),
        F.bool_or(~F.col("is_return")).alias("has_sale"),
    )
    totals = merged.agg(
        money(F.sum("amount")).alias("total_revenue"),
        F.countDistinct("customer_id").alias("active_customers"),
        F.countDistinct("invoice_no").alias("total_orders"),
        F.countDistinct(F.when(F.col("has_sale"), F.col("invoice_no"))).alias("sale_orders"),
    )
    labelled = F.count("churn_label")
    churn = features.agg(
        F.coalesce(percent(F.count_if("churn_label"), labelled), F.lit(0.0)).alias("churn_rate")
    )
    return totals.crossJoin(F.broadcast(churn)).select(
        "total_revenue",
        "active_customers",
        "total_orders",
        ratio(F.col("total_revenue"), F.col("sale_orders")).alias("avg_order_value"),
        "churn_rate",
    )


def segment_summary(features: DataFrame) -> DataFrame:
    """Per segment: size, mean R/F/M, churn rate (0 stays 0). Customers without one are left out."""
    n = F.count(F.lit(1))
    return (
        features.where(F.col("segment_name").isNotNull())
        .groupBy("cluster_id", "segment_name")
        .agg(
            n.alias("customer_count"),
            ratio(F.sum("recency_days"), F.count("recency_days")).alias("avg_recency"),
            ratio(F.sum("frequency"), F.count("frequency")).alias("avg_frequency"),
            ratio(F.sum("monetary"), F.count("monetary")).alias("avg_monetary"),
            percent(F.count_if("churn_label"), n).alias("churn_rate"),
        )
    )


def segment_share(segments: DataFrame) -> DataFrame:
    """Share of customers per segment, lowest mean revenue first. One row per segment."""
    everything = Window.partitionBy()
    return segments.select(
        "segment_name",
        "customer_count",
        "avg_monetary",
        percent(F.col("customer_count"), F.sum("customer_count").over(everything), 1).alias(
            "share_pct"
        ),
    ).orderBy("avg_monetary", "segment_name")


@dataclass(frozen=True)
class RiskPage:
    """One page of scored customers and the number of customers the filter selects."""

    rows: DataFrame
    total: DataFrame


def churn_risk_page(
    features: DataFrame,
    *,
    tier: str | None = None,
    segment: str | None = None,
    page: int = 1,
    limit: int = 50,
    settings: Settings = DEFAULTS,
) -> RiskPage:
    """Scored customers by falling probability, optionally of one tier and segment."""
    if tier not in (None, "high", "medium", "low"):
        raise ValueError(f"unknown risk tier {tier!r}")
    if page < 1 or not 1 <= limit <= 200:
        raise ValueError("page starts at 1 and limit is between 1 and 200")
    score = F.col("churn_probability")
    chosen = features.where(score.isNotNull())
    if tier == "high":
        chosen = chosen.where(score >= settings.tier_high)
    elif tier == "medium":
        chosen = chosen.where((score >= settings.tier_medium) & (score < settings.tier_high))
    elif tier == "low":
        chosen = chosen.where(score < settings.tier_medium)
    if segment is not None:
        chosen = chosen.where(F.col("segment_name") == segment)
    rows = (
        chosen.select(
            "customer_id",
            "churn_probability",
            risk_tier(score, settings).alias("risk_tier"),
            "segment_name",
            "recency_days",
            "frequency",
            "monetary",
        )
        .orderBy(score.desc(), "customer_id")
        .offset((page - 1) * limit)
        .limit(limit)
    )
    return RiskPage(rows=rows, total=chosen.agg(F.count(F.lit(1)).alias("total")))


def model_metrics(comparison: DataFrame) -> DataFrame:
    """The stored model table, best first."""
    return comparison.select(
        F.col("model").alias("model_name"), "precision", "recall", "f1", "auc_roc"
    ).orderBy(F.col("auc_roc").desc(), "model_name")


def top_features(importance: DataFrame, limit: int = 15) -> DataFrame:
    """The most important inputs with four decimals and a readable name."""
    return (
        importance.orderBy(F.col("importance").desc(), "feature")
        .limit(limit)
        .select(
            "feature",
            half_up(F.col("importance"), 4).alias("importance"),
            readable_feature(F.col("feature")).alias("display_name"),
        )
    )


def history_plus_forecast(
    history: DataFrame, forecast: DataFrame, *, below: float = DEFAULTS.truncated_below
) -> DataFrame:
    """History and forecast on one axis (`date` as `YYYY-MM`).

    The last month goes if it is under `below` of the mean over all months, itself included. The
    last month that stays is also the first point of the forecast, so that the lines meet.
    """
    everything = Window.partitionBy()
    last = F.max("date").over(everything)
    # One row per month in either frame.
    checked = history.select(
        "date",
        F.col("revenue").cast("double").alias("revenue"),
        (F.col("date") == last).alias("is_last"),
        (
            F.sum("revenue").over(everything).cast("double")
            / F.count(F.lit(1)).over(everything)
        ).alias("mean"),
    ).where(~F.col("is_last") | (F.col("revenue") >= F.col("mean") * below))
    kept = checked.withColumn("bridge", F.col("date") == last).select(
        "date",
        "revenue",
        F.when(F.col("bridge"), F.col("revenue")).alias("forecast"),
        F.when(F.col("bridge"), F.col("revenue")).alias("lower_bound"),
        F.when(F.col("bridge"), F.col("revenue")).alias("upper_bound"),
    )
    future = forecast.select(
        F.date_format("date", "yyyy-MM").alias("date"),
        half_up(F.col("forecast")).alias("forecast"),
        half_up(F.col("lower_bound")).alias("lower_bound"),
        half_up(F.col("upper_bound")).alias("upper_bound"),
    )
    return (
        kept.unionByName(future, allowMissingColumns=True)
        .groupBy("date")
        .agg(*[F.max(c).alias(c) for c in ("revenue", "forecast", "lower_bound", "upper_bound")])
    )


def forecast_totals(forecast: DataFrame, best: DataFrame) -> DataFrame:
    """Total and mean of the forecast and accuracy = 100 - MAPE of the chosen model, per series."""
    return (
        forecast.groupBy("series_key")
        .agg(
            half_up(F.sum(F.col("forecast").cast("decimal(22,2)")).cast("double")).alias(
                "total_forecast"
            ),
            ratio(F.sum(F.col("forecast").cast("decimal(22,2)")), F.count("forecast")).alias(
                "mean_forecast"
            ),
        )
        .join(best.select("series_key", "mape"), "series_key")
        .select(
            "series_key",
            "total_forecast",
            "mean_forecast",
            half_up(F.lit(100.0) - F.col("mape"), 2).alias("accuracy_pct"),
        )
    )
