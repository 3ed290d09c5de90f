"""Revenue over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpath.functions.numeric import percent, ratio
from tillpath.operators.orders import money, sales, with_calendar


def _period_totals(fact: DataFrame, dates: DataFrame, *period: str) -> DataFrame:
    """Per period over sale lines: revenue, distinct customers, distinct invoices."""
    merged = (
        with_calendar(sales(fact), dates, *period)
        .groupBy(*period, "customer_id", "invoice_no")
        .agg(F.sum("total_amount").alias("amount"))
    )
    return merged.groupBy(*period).agg(
        money(F.sum("amount")).alias("revenue"),
        F.countDistinct("customer_id").alias("active_customers"),
        F.countDistinct("invoice_no").alias("order_count"),
    )


def _change(now: Column, then: Column) -> Column:
    return percent(now - then, then)


def revenue_monthly(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Monthly revenue with running total, month-on-month and twelve-row-lag growth.

    `return_count` counts returns among sale lines, so it is always 0; kept as part of the report.
    The windows run over one row per month.
    """
    by_month = Window.orderBy("year", "month")
    revenue = F.col("revenue")
    return (
        _period_totals(fact, dates, "year", "month")
        .withColumn("prev_month_revenue", F.lag("revenue", 1).over(by_month))
        .withColumn("yoy_revenue", F.lag("revenue", 12).over(by_month))
        .select(
            "year",
            "month",
            "revenue",
            "active_customers",
            "order_count",
            F.lit(0).cast("long").alias("return_count"),
            F.sum("revenue").over(by_month).alias("cumulative_revenue"),
            "prev_month_revenue",
            _change(revenue, F.col("prev_month_revenue")).alias("mom_growth_pct"),
            "yoy_revenue",
            _change(revenue, F.col("yoy_revenue")).alias("yoy_growth_pct"),
        )
    )


def revenue_quarterly(fact: DataFrame, dates: DataFrame) -> DataFrame:
    return _period_totals(fact, dates, "year", "quarter").withColumn(
        "revenue_per_customer", ratio(F.col("revenue"), F.col("active_customers"))
    )


_GRANULARITY = {"monthly": "month", "quarterly": "quarter"}


def revenue_trend(fact: DataFrame, dates: DataFrame, granularity: str = "monthly") -> DataFrame:
    """Trend by month or quarter; the period number is in `month` either way."""
    if granularity not in _GRANULARITY:
        raise ValueError(f"granularity must be one of {sorted(_GRANULARITY)}, not {granularity!r}")
    period = _GRANULARITY[granularity]
    in_order = Window.orderBy("year", "month")
    totals = _period_totals(fact, dates, "year", period).withColumnRenamed(period, "month")
    return totals.withColumn(
        "mom_growth_pct", _change(F.col("revenue"), F.lag("revenue").over(in_order))
    )


def revenue_history(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """`YYYY-MM` and revenue over sale lines."""
    per_month = (
        with_calendar(sales(fact), dates, "year", "month")
        .groupBy("year", "month")
        .agg(money(F.sum("total_amount")).alias("revenue"))
    )
    return per_month.select(F.format_string("%04d-%02d", "year", "month").alias("date"), "revenue")
