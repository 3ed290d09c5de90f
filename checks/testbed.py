"""The star schema and the raw feed as views over the test tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpath.operators.star import calendar, with_demographics
from tillpath.schemas import Star
from tillpath.session import shared_folder
from tillpath.sources import tables

# Country names of the raw feed by nation number: most are in the region map, two are not.
COUNTRIES = [
    "United Kingdom", "EIRE", "France", "Germany", "Spain", "Netherlands", "Belgium",
    "Switzerland", "Portugal", "Italy", "Austria", "Denmark", "Norway", "Sweden", "USA", "Canada",
    "Brazil", "RSA", "Australia", "Japan", "Israel", "Bahrain", "Unspecified", "West Indies",
    "Atlantis",
]
HOME = "NATION_0"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their orders. Both grow with the data, so neither side is broadcast."""
    return _with_invoice(_flagged(spark, folder).join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ))


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    """The order lines; where they are moved, the flag is one bit and not a text."""
    return table(spark, folder, "lineitem").withColumn("is_return", F.col("l_returnflag") == "R")


def _with_invoice(lines: DataFrame) -> DataFrame:
    order = F.col("l_orderkey").cast("string")
    return lines.withColumn(
        "invoice_no", F.when(F.col("is_return"), F.concat(F.lit("C"), order)).otherwise(order)
    )


def _unit_price():
    return F.floor(F.col("l_extendedprice") * 100.0 / F.col("l_quantity") + 0.5) / 100.0


def _signed(column: str):
    return F.when(F.col("is_return"), -F.col(column)).otherwise(F.col(column))


def dates(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar spans the days of the orders table."""
    day = F.to_date("o_orderdate")
    return calendar(
        table(spark, folder, "orders").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    )


def fact(spark: SparkSession, folder: str) -> DataFrame:
    first = table(spark, folder, "orders").agg(F.min(F.to_date("o_orderdate")).alias("first_day"))
    return _lines(spark, folder).crossJoin(F.broadcast(first)).select(
        "invoice_no",
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        (F.datediff(F.to_date("o_orderdate"), "first_day") + 1).cast("int").alias("date_id"),
        _signed("l_quantity").cast("int").alias("quantity"),
        _unit_price().cast("decimal(10,2)").alias("unit_price"),
        _signed("l_extendedprice").cast("decimal(12,2)").alias("total_amount"),
        "is_return",
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with at least one line."""
    sold = table(spark, folder, "orders").join(
        table(spark, folder, "lineitem").select("l_orderkey"),
        F.col("o_orderkey") == F.col("l_orderkey"),
        "left_semi",
    )
    day = F.to_date("o_orderdate")
    spans = sold.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.min(day).alias("first_purchase"), F.max(day).alias("last_purchase")
    )
    places = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("region"),
        )
    )
    return with_demographics(spans.join(places, "customer_id"))


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_partkey").cast("string").alias("stock_code"),
        F.col("p_name").alias("description"),
        F.lit(None).cast("string").alias("category"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("avg_unit_price"),
    )


def star(spark: SparkSession, folder: str) -> Star:
    return Star(
        fact=fact(spark, folder),
        dates=dates(spark, folder),
        customers=customers(spark, folder),
        products=products(spark, folder),
    )


def stored_star(spark: SparkSession, folder: str, path: str | None = None) -> Star:
    """The star written as tables and read back."""
    path = path or os.path.join(shared_folder(spark), f"star-{uuid.uuid4().hex}")
    made = star(spark, folder)
    for name in tables.TABLES:
        tables.write_dimension(getattr(made, name.removeprefix("dim_")), path, name)
    lines = made.fact.withColumn("transaction_id", F.lit(0).cast("long"))
    tables.write_fact(lines, made.dates, os.path.join(path, "fact_transactions"))
    return tables.read_star(spark, path)


def raw_parts(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The raw feed in two overlapping parts, with faults planted by key arithmetic.

    Orders meet their customers before the lines, which are many more, so lines are shuffled twice.
    """
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    lines = _with_invoice(
        _flagged(spark, folder)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    code = F.when(part % 97 == 0, "POST").when(part % 101 == 0, "M").otherwise(part.cast("string"))
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "))
    size = (
        F.when(F.col("l_quantity") == 7, 0)
        .when((F.col("l_quantity") == 50) & (part % 7 == 0), 5000)
        .otherwise(F.col("l_quantity").cast("int"))
    )
    names = F.array(*[F.lit(c) for c in COUNTRIES])
    feed = lines.select(
        F.col("invoice_no").alias("Invoice"),
        code.alias("StockCode"),
        F.when(part % 5 == 0, padded).otherwise(F.col("p_name")).alias("Description"),
        F.when(F.col("is_return"), -size).otherwise(size).alias("Quantity"),
        F.col("o_orderdate").cast("timestamp").alias("InvoiceDate"),
        F.when(order % 53 == 0, 0.0)
        .when(part % 89 == 0, 0.004)
        .when(part % 83 == 0, 0.015)
        .otherwise(_unit_price())
        .alias("Price"),
        F.when(order % 9 != 0, F.col("o_custkey").cast("double")).alias("Customer ID"),
        F.element_at(names, F.col("c_nationkey") + 1).alias("Country"),
    )
    return [
        feed.where(F.col("InvoiceDate") < "1999-01-01"),
        feed.where(F.col("InvoiceDate") >= "1998-12-01"),
    ]


def key_hash(column: str):
    """0 .. 2^32-1 from the text of a key."""
    digest = F.substring(F.md5(F.col(column).cast("string")), 1, 8)
    return F.conv(digest, 16, 10).cast("long")


def with_fixed_clusters(scores: DataFrame, clusters: int = 4) -> DataFrame:
    """Clusters by hash of the customer, so that profile logic has an exact expectation."""
    return scores.withColumn("cluster_id", (key_hash("customer_id") % clusters).cast("int"))


def fixed_scores(features: DataFrame) -> DataFrame:
    """Scores by hash for three made-up models, with the observed label."""
    label = F.col("churn_label").cast("int")
    base = key_hash("customer_id") % 10000 / 10000.0
    good = F.floor((base + label) * 5000.0) / 10000.0
    coarse = F.floor(base * 20.0) / 20.0
    return features.select(
        "customer_id",
        label.alias("label"),
        F.inline(F.array(
            F.struct(F.lit("hash").alias("model"), base.alias("score")),
            F.struct(F.lit("informed").alias("model"), good.alias("score")),
            F.struct(F.lit("coarse").alias("model"), coarse.alias("score")),
        )),
    )


def feature_table(values: DataFrame) -> DataFrame:
    """A filled customer feature table from R/F/M values: clusters and scores by hash.

    Every eleventh hash has no segment, every thirteenth no score.
    """
    key = key_hash("customer_id")
    cluster = (key % 4).cast("int")
    score = (key % 10000 / 10000.0).cast("decimal(5,4)")
    return values.select(
        "customer_id",
        "recency_days",
        "frequency",
        F.col("monetary").cast("decimal(12,2)").alias("monetary"),
        F.lit(None).cast("decimal(10,2)").alias("avg_order_value"),
        F.lit(None).cast("decimal(5,4)").alias("return_rate"),
        F.lit(None).cast("long").alias("product_diversity"),
        F.lit(None).cast("int").alias("days_active"),
        F.lit(None).cast("decimal(8,4)").alias("purchase_trend"),
        F.lit(None).cast("string").alias("rfm_segment"),
        F.when(key % 11 != 0, cluster).alias("cluster_id"),
        F.when(key % 11 != 0, F.format_string("Segment %d", cluster)).alias("segment_name"),
        (F.col("recency_days") > 90).alias("churn_label"),
        F.when(key % 13 != 0, score).alias("churn_probability"),
    )


