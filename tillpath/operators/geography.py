"""Revenue by country and region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.functions.numeric import percent, ratio
from tillpath.operators.orders import money, sold


def geo_breakdown(fact: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers and orders (returns included) and sale revenue per country.

    The distinct counts shuffle on (country, customer) and (country, invoice), so a home country
    with most of the lines does not end up in one task.
    """
    merged = fact.groupBy("customer_id", "invoice_no").agg(
        money(F.sum(sold("total_amount"))).alias("amount")
    )
    placed = merged.join(customers.select("customer_id", "country", "region"), "customer_id")
    return (
        placed.groupBy("country", "region")
        .agg(
            F.countDistinct("customer_id").alias("customers"),
            F.countDistinct("invoice_no").alias("orders"),
            money(F.sum("amount")).alias("revenue"),
        )
        .withColumn("revenue_per_customer", ratio(F.col("revenue"), F.col("customers")))
    )


def region_rollup(breakdown: DataFrame) -> DataFrame:
    return (
        breakdown.groupBy("region")
        .agg(money(F.sum("revenue")).alias("revenue"), F.sum("customers").alias("customers"))
        .orderBy("revenue", "region")
    )


def country_share(breakdown: DataFrame, country: str) -> DataFrame:
    """One country's percentage of revenue and the number of countries."""
    home = F.sum(F.when(F.col("country") == country, F.col("revenue")))
    return breakdown.agg(
        money(home).alias("home_revenue"),
        money(F.sum("revenue")).alias("revenue"),
        F.count(F.lit(1)).alias("countries"),
    ).select(
        F.lit(country).alias("country"),
        percent(F.col("home_revenue"), F.col("revenue")).alias("share_pct"),
        "countries",
    )
