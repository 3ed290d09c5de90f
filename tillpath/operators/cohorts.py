"""Retention of customer cohorts by month of first purchase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.functions.numeric import percent
from tillpath.operators.orders import sales, with_calendar

LAST_OFFSET = 12


def cohort_retention(
    fact: DataFrame, dates: DataFrame, customers: DataFrame, last_offset: int = LAST_OFFSET
) -> DataFrame:
    """Customers with a sale, per cohort and months since first purchase.

    Activity is distinct per (customer, month) and a customer has one cohort, so a plain count per
    (cohort, offset) is the number of distinct customers.
    """
    def number(day: str) -> F.Column:
        return F.year(day) * 12 + F.month(day)

    activity = (
        with_calendar(sales(fact), dates, "year", "month")
        .select("customer_id", (F.col("year") * 12 + F.col("month")).alias("active_month"))
        .distinct()
    )
    cohort_of = customers.select(
        "customer_id",
        F.date_format("first_purchase", "yyyy-MM").alias("cohort"),
        number("first_purchase").alias("cohort_month"),
    )
    # One row per month, bounded by the calendar.
    sizes = cohort_of.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_customers"))
    offset = (F.col("active_month") - F.col("cohort_month")).cast("int")
    retained = (
        activity.join(cohort_of, "customer_id")
        .select("cohort", offset.alias("period_number"))
        .where(F.col("period_number").between(0, last_offset))
        .groupBy("cohort", "period_number")
        .agg(F.count(F.lit(1)).alias("retained"))
    )
    return retained.join(F.broadcast(sizes), "cohort").select(
        "cohort",
        "cohort_customers",
        "period_number",
        "retained",
        percent(F.col("retained"), F.col("cohort_customers")).alias("retention_pct"),
    )


def cohort_matrix(retention: DataFrame, last_offset: int = LAST_OFFSET) -> DataFrame:
    """Cohorts as rows, offsets as columns `m0`..`m12`. The offsets are known, so no job finds them."""
    offsets = list(range(last_offset + 1))
    wide = retention.groupBy("cohort").pivot("period_number", offsets).agg(F.first("retention_pct"))
    return wide.withColumnsRenamed({str(o): f"m{o}" for o in offsets})
