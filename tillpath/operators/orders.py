"""Line pre-aggregates that the reports share.

Reports count distinct customers, invoices or days. Lines are therefore first merged per invoice:
partial sums run before the shuffle, the shuffle key includes the invoice, so one customer, product
or country with a large share of all lines is spread over tasks, and the distinct counts that
follow work on the few merged rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(22,2)"


def with_calendar(fact: DataFrame, dates: DataFrame, *columns: str) -> DataFrame:
    """Add calendar columns. The calendar has one row per day, hence the broadcast.

    A stored fact already has `year` and `month` from its folders. They are part of the join key, so the days
    that a filtered calendar still has decide at run time which folders are read.
    """
    keys = ["date_id", *[c for c in ("year", "month") if c in fact.columns and c in dates.columns]]
    added = [c for c in columns if c not in keys]
    lines = fact.drop(*added)
    return lines.join(F.broadcast(dates.select(*keys, *added)), keys)


def sales(fact: DataFrame) -> DataFrame:
    return fact.where(~F.col("is_return"))


def sold(value: Column | str) -> Column:
    """The value on sale lines, NULL on returns."""
    column = F.col(value) if isinstance(value, str) else value
    return F.when(~F.col("is_return"), column)


def returned(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("is_return"), column)


def money(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast(MONEY)


def invoices(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per (customer, invoice): amounts, line counts, first and last days."""
    day = F.col("full_date")
    return (
        with_calendar(fact, dates, "full_date")
        .groupBy("customer_id", "invoice_no")
        .agg(
            money(F.sum(sold("total_amount"))).alias("sold_amount"),
            money(F.sum(returned("total_amount"))).alias("returned_amount"),
            F.count(sold("total_amount")).alias("sold_lines"),
            F.count_if("is_return").alias("returned_lines"),
            F.sum(sold(F.abs("quantity").cast("long"))).alias("sold_units"),
            F.count(sold("quantity")).alias("sold_unit_lines"),
            F.count_if(~F.col("is_return")).alias("sale_rows"),
            F.max(day).alias("last_day"),
            F.min(day).alias("first_day"),
            F.min(sold(day)).alias("first_sale_day"),
            F.max(sold(day)).alias("last_sale_day"),
        )
        .withColumn("has_sale", F.col("sale_rows") > 0)
        .withColumn("has_return", F.col("returned_lines") > 0)
    )


def last_calendar_day(dates: DataFrame) -> DataFrame:
    """One row `ref_date`: the last day of the data."""
    return dates.agg(F.max("full_date").alias("ref_date"))
