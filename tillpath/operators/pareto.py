"""Concentration of revenue over products and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.functions.numeric import percent
from tillpath.operators.orders import MONEY, money, sales
from tillpath.operators.ranking import concentration


def product_totals(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, units and distinct buyers per sold product.

    Lines are merged per (product, customer) first, so buyers are a plain count afterwards and a
    product with a large share of all lines is spread over tasks. Names are joined last.
    """
    per_buyer = (
        sales(fact)
        .groupBy("product_id", "customer_id")
        .agg(F.sum("total_amount").alias("amount"), F.sum("quantity").alias("units"))
    )
    totals = per_buyer.groupBy("product_id").agg(
        money(F.sum("amount")).alias("revenue"),
        F.sum("units").alias("units_sold"),
        F.count("customer_id").alias("unique_buyers"),
    )
    return totals.join(products.select("product_id", "stock_code", "description"), "product_id")


def pareto_products(
    fact: DataFrame, products: DataFrame, *, partitions: int | None = None
) -> DataFrame:
    ranked = concentration(
        product_totals(fact, products), "revenue", ["product_id"], partitions=partitions
    )
    return ranked.select(
        "rank",
        "stock_code",
        "description",
        "revenue",
        "units_sold",
        "unique_buyers",
        F.col("cumulative_value").cast(MONEY).alias("cumulative_revenue"),
        percent(F.col("cumulative_value"), F.col("total_value")).alias("cumulative_pct"),
        percent(F.col("rank"), F.col("n_rows")).alias("product_pct"),
    )


def top_products(pareto: DataFrame, limit: int = 50) -> DataFrame:
    """The head of the product report."""
    return pareto.orderBy("rank").limit(limit)


def pareto_customers(
    fact: DataFrame,
    *,
    share: float = 25.0,
    at_least: int = 20,
    partitions: int | None = None,
) -> DataFrame:
    """The customers up to `share` percent of all, and the first `at_least` in any case."""
    totals = sales(fact).groupBy("customer_id").agg(money(F.sum("total_amount")).alias("revenue"))
    ranked = concentration(totals, "revenue", ["customer_id"], partitions=partitions)
    return ranked.select(
        "rank",
        "customer_id",
        "revenue",
        percent(F.col("cumulative_value"), F.col("total_value")).alias("cumulative_pct"),
        percent(F.col("rank"), F.col("n_rows")).alias("customer_pct"),
    ).where((F.col("customer_pct") <= share) | (F.col("rank") <= at_least))


def pareto_point(pareto: DataFrame, level: float = 80.0) -> DataFrame:
    """Where the cumulative share reaches `level`, as rank / n and as zero-based index / n."""
    reached = F.min(F.when(F.col("cumulative_pct") >= level, F.col("rank")))
    return pareto.agg(reached.alias("rank_at_level"), F.count(F.lit(1)).alias("products")).select(
        "products",
        "rank_at_level",
        percent(F.col("rank_at_level"), F.col("products")).alias("pct_by_rank"),
        percent(F.col("rank_at_level") - 1, F.col("products")).alias("pct_by_index"),
    )
