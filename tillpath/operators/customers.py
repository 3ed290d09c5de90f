"""Customer value: lifetime value, RFM scores, churn metrics and their summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.config import DEFAULTS, Settings
from tillpath.functions.numeric import half_up, percent, ratio
from tillpath.functions.text import tenure_bucket
from tillpath.operators.orders import (
    invoices,
    last_calendar_day,
    money,
    returned,
    sold,
    with_calendar,
)
from tillpath.operators.ranking import exact_quantiles
from tillpath.operators.selection import bounds, group_of, sortable
from tillpath.session import cut


def _tenure() -> Column:
    return F.datediff("last_purchase", "first_purchase")


def customer_ltv(fact: DataFrame, dates: DataFrame, customers: DataFrame) -> DataFrame:
    """Historical value per customer.

    Lines are merged per (customer, invoice, day) and stored. Orders and active days are two plain counts from
    the stored rows, each over keys of two parts first, so that nothing is counted distinct and a customer
    with very many lines is spread.
    """
    daily = cut(
        with_calendar(fact, dates, "full_date")
        .groupBy("customer_id", "invoice_no", "full_date")
        .agg(
            money(F.sum(sold("total_amount"))).alias("sold_amount"),
            money(F.sum(returned("total_amount"))).alias("returned_amount"),
            F.bool_or("is_return").alias("has_return"),
            F.bool_or(~F.col("is_return")).alias("has_sale"),
        )
    )
    orders = daily.groupBy("customer_id", "invoice_no").agg(
        F.sum("sold_amount").alias("sold_amount"),
        F.sum("returned_amount").alias("returned_amount"),
        F.bool_or("has_return").alias("has_return"),
        F.bool_or("has_sale").alias("has_sale"),
    )
    known = F.col("invoice_no").isNotNull()
    totals = orders.groupBy("customer_id").agg(
        money(F.sum("sold_amount")).alias("gross_revenue"),
        money(F.sum("returned_amount")).alias("return_value"),
        F.count_if(known).alias("total_orders"),
        F.count_if(known & F.col("has_return")).alias("return_orders"),
        F.count_if(known & F.col("has_sale")).alias("sale_orders"),
    )
    active = (
        daily.groupBy("customer_id", "full_date")
        .agg(F.lit(1).alias("seen"))
        .groupBy("customer_id")
        .agg(F.count("full_date").alias("active_days"))
    )
    totals = totals.join(active, "customer_id")
    net = F.col("net_revenue")
    days = F.col("tenure_days")
    return (
        totals.join(customers, "customer_id")
        .withColumn("net_revenue", (F.col("gross_revenue") + F.col("return_value")).cast("decimal(22,2)"))
        .withColumn("tenure_days", _tenure())
        .select(
            "customer_id",
            "country",
            "region",
            "acquisition_channel",
            "first_purchase",
            "last_purchase",
            "tenure_days",
            "gross_revenue",
            "return_value",
            "net_revenue",
            "total_orders",
            "return_orders",
            "active_days",
            ratio(F.col("gross_revenue"), F.col("sale_orders")).alias("avg_order_value"),
            F.when(days > 30, half_up(net.cast("double") * 30.0 / F.nullif(days, F.lit(0))))
            .otherwise(net.cast("double"))
            .alias("monthly_revenue_rate"),
            tenure_bucket(days).alias("tenure_bucket"),
        )
    )


def tenure_summary(
    fact: DataFrame, customers: DataFrame, *, partitions: int | None = None
) -> DataFrame:
    """Customer value by tenure bucket.

    Most customers can be in one bucket, so the median comes from `exact_quantiles`, which does
    not gather a group.
    """
    merged = fact.groupBy("customer_id", "invoice_no").agg(F.sum("total_amount").alias("amount"))
    totals = merged.groupBy("customer_id").agg(
        money(F.sum("amount")).alias("net_revenue"), F.count(F.lit(1)).alias("total_orders")
    )
    # The medians and the sums both read it.
    bucketed = cut(totals.join(
        customers.select("customer_id", tenure_bucket(_tenure()).alias("tenure_bucket")),
        "customer_id",
    ))
    medians = exact_quantiles(
        bucketed, "net_revenue", {"median": 0.5}, group=["tenure_bucket"], partitions=partitions
    )
    buckets = bucketed.groupBy("tenure_bucket").agg(
        F.count(F.lit(1)).alias("customer_count"),
        money(F.sum("net_revenue")).alias("total_revenue"),
        F.sum("total_orders").alias("orders"),
    )
    return buckets.join(medians, "tenure_bucket").select(
        "tenure_bucket",
        "customer_count",
        ratio(F.col("total_revenue"), F.col("customer_count")).alias("avg_clv"),
        half_up(F.col("median")).alias("median_clv"),
        "total_revenue",
        ratio(F.col("orders"), F.col("customer_count"), 1).alias("avg_orders"),
    )


def rfm_values(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Recency, frequency and monetary value of customers with at least one paid sale."""
    totals = (
        invoices(fact, dates)
        .groupBy("customer_id")
        .agg(
            F.max("last_day").alias("last_day"),
            F.count_if("has_sale").alias("frequency"),
            money(F.sum("sold_amount")).alias("monetary"),
        )
    )
    return (
        totals.where((F.col("frequency") > 0) & (F.col("monetary") > 0))
        .crossJoin(F.broadcast(last_calendar_day(dates)))
        .select(
            "customer_id",
            F.datediff("ref_date", "last_day").alias("recency_days"),
            "frequency",
            "monetary",
        )
    )


def score_rfm(
    values: DataFrame, settings: Settings = DEFAULTS, *, partitions: int | None = None
) -> DataFrame:
    """Quintile scores. Each metric has its own order; ties are split by customer.

    The bounds of the groups are selected by counting (see `selection`), so customers are stored once,
    in `partitions` if given, and never sorted.
    """
    stored = cut(values.repartition(partitions, "customer_id") if partitions else values)
    keys = {
        "r_score": -sortable(stored, "recency_days"),
        "f_score": sortable(stored, "frequency"),
        "m_score": sortable(stored, "monetary"),
    }
    found = bounds(stored, keys, "customer_id", settings.rfm_groups)
    scored = stored.withColumns(
        {name: group_of(key, F.col("customer_id"), found[name]) for name, key in keys.items()}
    )
    return scored.withColumn("rfm_segment", F.concat_ws("-", *keys)).withColumn(
        "rfm_total", F.col("r_score") + F.col("f_score") + F.col("m_score")
    )


def rfm_scores(
    fact: DataFrame,
    dates: DataFrame,
    settings: Settings = DEFAULTS,
    *,
    partitions: int | None = None,
) -> DataFrame:
    return score_rfm(rfm_values(fact, dates), settings, partitions=partitions)


def rfm_summary(scores: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return scores.groupBy("rfm_total").agg(
        n.alias("customer_count"),
        ratio(F.sum("recency_days"), n).alias("avg_recency"),
        ratio(F.sum("frequency"), n).alias("avg_frequency"),
        ratio(F.sum("monetary"), n).alias("avg_monetary"),
    )


def rfm_extremes(scores: DataFrame, n: int = 10) -> DataFrame:
    """The `n` best and `n` worst customers by total score."""
    columns = ["customer_id", "recency_days", "frequency", "monetary", "rfm_segment", "rfm_total"]
    best = scores.orderBy(F.col("rfm_total").desc(), "customer_id").limit(n)
    worst = scores.orderBy("rfm_total", "customer_id").limit(n)
    return best.select(F.lit("top").alias("side"), *columns).unionByName(
        worst.select(F.lit("bottom").alias("side"), *columns)
    )


def churn_metrics(
    fact: DataFrame,
    dates: DataFrame,
    customers: DataFrame,
    settings: Settings = DEFAULTS,
    *,
    reference_date: dt.date | None = None,
) -> DataFrame:
    """Behaviour per customer and whether it counts as churned on the reference date.

    The reference date is the last day of the data unless given.
    """
    if reference_date is None:
        reference = last_calendar_day(dates)
    else:
        reference = dates.sparkSession.range(1).select(F.lit(reference_date).alias("ref_date"))
    totals = (
        invoices(fact, dates)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.count_if("has_return").alias("return_orders"),
            money(F.sum("sold_amount")).alias("revenue"),
            F.sum("sold_lines").alias("sold_lines"),
        )
    )
    amount = F.col("revenue").cast("double")
    return (
        totals.join(customers.select("customer_id", "last_purchase"), "customer_id")
        .crossJoin(F.broadcast(reference))
        .withColumn("days_since_last", F.datediff("ref_date", "last_purchase"))
        .select(
            "customer_id",
            "last_purchase",
            "days_since_last",
            "order_count",
            "revenue",
            F.try_divide(amount, F.col("sold_lines").cast("double")).alias("avg_txn_value"),
            F.try_divide(
                F.col("return_orders").cast("double"), F.col("order_count").cast("double")
            ).alias("return_rate"),
            (F.col("days_since_last") > settings.churn_days).alias("is_churned"),
        )
    )


def churn_split(metrics: DataFrame) -> DataFrame:
    churned = F.count_if("is_churned")
    total = F.count(F.lit(1))
    return metrics.agg(
        churned.alias("churned"),
        (total - churned).alias("retained"),
        total.alias("total"),
        percent(churned, total).alias("churn_pct"),
    )
