"""The one-row summary of the exploratory report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.functions.numeric import ratio
from tillpath.operators.orders import money


def eda_summary(
    monthly: DataFrame,
    retention: DataFrame,
    pareto_at_80: DataFrame,
    home_share: DataFrame,
    churn: DataFrame,
) -> DataFrame:
    """Headline numbers of the other reports, each input being a report or a one-row result.

    The truncated last month is part of the growth mean, as in the monthly report itself. Rounded
    percentages are averaged as decimals, so the mean does not depend on row order.
    """
    def mean(column: str):
        value = F.col(column).cast("decimal(18,2)")
        return ratio(F.sum(value), F.count(value))

    best = F.max_by(
        F.format_string("%d-%02d", "year", "month"),
        F.struct("revenue", -F.col("year"), -F.col("month")),
    )
    revenue = monthly.agg(
        money(F.sum("revenue")).alias("total_revenue"),
        best.alias("peak_month"),
        mean("mom_growth_pct").alias("avg_mom_growth"),
    )
    third = retention.where(F.col("period_number") == 3).agg(
        mean("retention_pct").alias("avg_3month_retention")
    )
    return (
        revenue.crossJoin(F.broadcast(third))
        .crossJoin(F.broadcast(pareto_at_80.select(
            F.col("pct_by_index").alias("pareto_pct_products_for_80_revenue")
        )))
        .crossJoin(F.broadcast(home_share.select(F.col("share_pct").alias("home_revenue_share"))))
        .crossJoin(F.broadcast(churn.select(F.col("churn_pct").alias("churn_rate"))))
    )
