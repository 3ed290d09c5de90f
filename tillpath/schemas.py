"""Table schemas of the data model and the container that holds the star."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW = T.StructType([
    T.StructField("Invoice", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("InvoiceDate", T.TimestampType()),
    T.StructField("Price", T.DoubleType()),
    T.StructField("Customer ID", T.DoubleType()),
    T.StructField("Country", T.StringType()),
])

CLEANED = T.StructType([
    T.StructField("invoice", T.StringType()),
    T.StructField("stock_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("invoice_date", T.TimestampType()),
    T.StructField("price", T.DecimalType(18, 6)),
    T.StructField("customer_id", T.LongType()),
    T.StructField("country", T.StringType()),
    T.StructField("is_return", T.BooleanType()),
    T.StructField("total_amount", T.DecimalType(12, 2)),
])

DIM_DATES = T.StructType([
    T.StructField("date_id", T.IntegerType()),
    T.StructField("full_date", T.DateType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("day_name", T.StringType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("month_name", T.StringType()),
    T.StructField("quarter", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("is_holiday", T.BooleanType()),
    T.StructField("is_weekend", T.BooleanType()),
])

DIM_CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("country", T.StringType()),
    T.StructField("first_purchase", T.DateType()),
    T.StructField("last_purchase", T.DateType()),
    T.StructField("age_group", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("acquisition_channel", T.StringType()),
])

DIM_PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("stock_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("avg_unit_price", T.DecimalType(10, 2)),
])

FACT = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("invoice_no", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("date_id", T.IntegerType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DecimalType(10, 2)),
    T.StructField("total_amount", T.DecimalType(12, 2)),
    T.StructField("is_return", T.BooleanType()),
])

CUSTOMER_FEATURES = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("recency_days", T.IntegerType()),
    T.StructField("frequency", T.LongType()),
    T.StructField("monetary", T.DecimalType(12, 2)),
    T.StructField("avg_order_value", T.DecimalType(10, 2)),
    T.StructField("return_rate", T.DecimalType(5, 4)),
    T.StructField("product_diversity", T.LongType()),
    T.StructField("days_active", T.IntegerType()),
    T.StructField("purchase_trend", T.DecimalType(8, 4)),
    T.StructField("rfm_segment", T.StringType()),
    T.StructField("cluster_id", T.IntegerType()),
    T.StructField("segment_name", T.StringType()),
    T.StructField("churn_label", T.BooleanType()),
    T.StructField("churn_probability", T.DecimalType(5, 4)),
])

MODEL_COMPARISON = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("auc_roc", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
])

FEATURE_IMPORTANCE = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("importance", T.DoubleType()),
])

FORECAST_COMPARISON = T.StructType([
    T.StructField("series_key", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("mape", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
])

FORECAST = T.StructType([
    T.StructField("series_key", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("forecast", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
])


@dataclass(frozen=True)
class Star:
    """The four tables of the star schema."""

    fact: DataFrame
    dates: DataFrame
    customers: DataFrame
    products: DataFrame
