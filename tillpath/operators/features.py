"""Customer features for the churn models, and the split, encoding and scaling of them."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.config import DEFAULTS, Settings
from tillpath.fixed_values import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from tillpath.functions.numeric import unit_hash
from tillpath.operators.orders import invoices, last_calendar_day, money
from tillpath.operators.ranking import group_key


def tenure_midpoint() -> Column:
    """First purchase plus half the span in whole days."""
    half = F.floor(F.datediff("last_purchase", "first_purchase") / 2).cast("int")
    return F.date_add("first_purchase", half)


def churn_label(recency: Column, settings: Settings = DEFAULTS) -> Column:
    return recency > settings.churn_days


def _customer_days(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Invoices merged per (customer, first sale day, last sale day).

    The midpoint of a customer is only known after a join on the customer. Merging first leaves
    at most a few rows per calendar day of one customer, so the join has no hot key.
    """
    return (
        invoices(fact, dates)
        .groupBy("customer_id", "first_sale_day", "last_sale_day")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.count_if("has_sale").alias("sale_orders"),
            F.count_if("has_return").alias("return_orders"),
            money(F.sum("sold_amount")).alias("sold_amount"),
            F.sum("sold_units").alias("sold_units"),
            F.sum("sold_unit_lines").alias("sold_unit_lines"),
            F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
        )
    )


def purchase_trend(fact: DataFrame, dates: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders from the middle of the tenure on minus orders before it."""
    joined = _customer_days(fact, dates).join(
        customers.select("customer_id", tenure_midpoint().alias("midpoint")), "customer_id"
    )
    return joined.groupBy("customer_id").agg(_trend().alias("purchase_trend"))


def _trend() -> Column:
    late = F.when(F.col("last_sale_day") >= F.col("midpoint"), F.col("sale_orders"))
    early = F.when(F.col("first_sale_day") < F.col("midpoint"), F.col("sale_orders"))
    return F.coalesce(F.sum(late), F.lit(0)) - F.coalesce(F.sum(early), F.lit(0))


def churn_features(
    fact: DataFrame,
    dates: DataFrame,
    customers: DataFrame,
    segments: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One row per customer with a paid sale.

    `order_count` repeats `frequency`, as the report has both. `segments` is the customer feature
    table (`customer_id`, `segment_name`, `cluster_id`) where segmentation has already run.
    """
    joined = _customer_days(fact, dates).join(
        customers.select(
            "customer_id", "first_purchase", "region", "acquisition_channel", "age_group",
            tenure_midpoint().alias("midpoint"),
        ),
        "customer_id",
    )
    totals = joined.groupBy("customer_id").agg(
        F.max("last_day").alias("last_day"),
        F.min("first_day").alias("first_day"),
        F.min("first_purchase").alias("first_purchase"),
        F.sum("sale_orders").alias("frequency"),
        F.sum("return_orders").alias("return_orders"),
        F.sum("orders").alias("orders"),
        money(F.sum("sold_amount")).alias("monetary"),
        F.sum("sold_units").alias("sold_units"),
        F.sum("sold_unit_lines").alias("sold_unit_lines"),
        _trend().alias("purchase_trend"),
        F.min("region").alias("region"),
        F.min("acquisition_channel").alias("acquisition_channel"),
        F.min("age_group").alias("age_group"),
    )

    def over(top: str, bottom: str) -> Column:
        return F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double"))

    recency = F.datediff("ref_date", "last_day")
    features = (
        totals.where((F.col("frequency") > 0) & (F.col("monetary") > 0))
        .crossJoin(F.broadcast(last_calendar_day(dates)))
        .select(
            "customer_id",
            recency.alias("recency_days"),
            "frequency",
            "monetary",
            over("monetary", "frequency").alias("avg_order_value"),
            over("return_orders", "orders").alias("return_rate"),
            F.col("frequency").alias("order_count"),
            F.datediff("last_day", "first_day").alias("days_active"),
            F.datediff("ref_date", "first_purchase").alias("tenure_days"),
            over("sold_units", "sold_unit_lines").alias("avg_items_per_order"),
            "purchase_trend",
            "region",
            "acquisition_channel",
            "age_group",
            churn_label(recency, settings).alias("churn_label"),
        )
    )
    if segments is None:
        return features
    return features.join(
        segments.select("customer_id", "segment_name", "cluster_id"), "customer_id", "left"
    )


def product_diversity(fact: DataFrame) -> DataFrame:
    """Distinct products a customer bought."""
    bought = fact.where(~F.col("is_return")).select("customer_id", "product_id").distinct()
    return bought.groupBy("customer_id").agg(F.count(F.lit(1)).alias("product_diversity"))


def impute(features: DataFrame) -> DataFrame:
    """Missing numbers become 0, missing categories `Unknown`. Numbers become doubles."""
    numbers = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC_FEATURES
    }
    return features.withColumns(numbers).na.fill({c: "Unknown" for c in CATEGORICAL_FEATURES})


def fit_encoder(features: DataFrame) -> StringIndexerModel:
    """Alphabetical codes per category; the categories are short closed lists."""
    return StringIndexer(
        inputCols=CATEGORICAL_FEATURES,
        outputCols=[f"{c}_enc" for c in CATEGORICAL_FEATURES],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(features)


def encode_categories(features: DataFrame) -> DataFrame:
    return fit_encoder(features).transform(features)


def stratified_split(
    features: DataFrame,
    settings: Settings = DEFAULTS,
    *,
    label: str = "churn_label",
    key: str = "customer_id",
    partitions: int | None = None,
) -> DataFrame:
    """Add `is_test`: in each class the same share of rows, drawn by hash of the key.

    The draw is exact and repeatable. A class can be most of the rows, so places inside a class
    come from the distributed numbering.
    """
    drawn = features.withColumn("_draw", unit_hash(F.col(key), f"split{settings.seed}"))
    placed = group_key(
        drawn, [label], ["_draw", key], "_place", total="_rows", partitions=partitions
    )
    test_rows = F.floor(F.col("_rows") * settings.test_share + 0.5)
    return placed.withColumn("is_test", F.col("_place") <= test_rows).drop("_draw", "_place", "_rows")


def scaling(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row with mean and population deviation of each column."""
    return train.agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_dev_{c}") for c in columns],
    )


def scale_features(split: DataFrame, columns: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """z-scores with mean and deviation of the training rows only; a constant column becomes 0."""
    fitted = scaling(split.where(~F.col("is_test")), columns)
    scaled = split.crossJoin(F.broadcast(fitted))
    return scaled.withColumns({
        c: F.coalesce(
            F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_dev_{c}")), F.lit(0.0)
        )
        for c in columns
    }).select(*split.columns)
