"""Star schema build: three dimensions and the fact table from cleaned lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpath.config import DEFAULTS, Settings
from tillpath.fixed_values import AGE_SHARES, CHANNEL_SHARES, OTHER_REGION
from tillpath.functions.numeric import weighted_choice
from tillpath.operators.ranking import dense_key
from tillpath.schemas import CLEANED, DIM_CUSTOMERS, DIM_DATES, DIM_PRODUCTS, Star
from tillpath.session import cut, stage


def calendar(span: DataFrame) -> DataFrame:
    """One row per day from a one-row frame (`first_day`, `last_day`); `date_id` counts from 1."""
    day = F.col("full_date")
    days = span.select(
        "first_day",
        F.explode(F.sequence("first_day", "last_day", F.expr("interval 1 day"))).alias("full_date"),
    )
    return days.select(
        (F.datediff(day, F.col("first_day")) + 1).cast("int").alias("date_id"),
        day,
        F.weekday(day).alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        F.lit(False).alias("is_holiday"),
        (F.weekday(day) >= 5).alias("is_weekend"),
    )


def dim_dates(lines: DataFrame) -> DataFrame:
    day = F.to_date("invoice_date")
    span = lines.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return calendar(span).select(*DIM_DATES.names)


def dim_products(lines: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """One row per sold stock code: most common description, mean price, id in code order.

    Counting per (code, description) first keeps the state of a group to one candidate, however
    many spellings a code has; among equally common ones the smallest text wins.
    """
    sold = lines.where(~F.col("is_return") & F.col("stock_code").isNotNull())
    spellings = sold.groupBy("stock_code", "description").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("price").cast("decimal(18,6)")).alias("price_sum"),
        F.count("price").alias("price_n"),
    )
    named = F.col("description").isNotNull()
    best = F.min(F.when(named, F.struct((-F.col("n")).alias("falling"), F.col("description"))))
    codes = spellings.groupBy("stock_code").agg(
        best.alias("best"), F.sum("price_sum").alias("price_sum"), F.sum("price_n").alias("price_n")
    )
    # The quotient has 22 decimals, so that only the last step rounds to cents.
    total = F.col("price_sum").cast("decimal(22,6)")
    mean = F.try_divide(total, F.col("price_n")).cast("decimal(10,2)")
    products = codes.select(
        "stock_code",
        F.col("best.description").alias("description"),
        F.lit(None).cast("string").alias("category"),
        mean.alias("avg_unit_price"),
    )
    return dense_key(products, ["stock_code"], "product_id", partitions=partitions).select(
        *DIM_PRODUCTS.names
    )


def region_lookup(spark: SparkSession, settings: Settings = DEFAULTS) -> DataFrame:
    return spark.createDataFrame(list(settings.region_of.items()), "country string, region string")


def with_region(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add the region of `country`. The lookup is a fixed list, hence the broadcast."""
    known = region_lookup(df.sparkSession, settings)
    return df.join(F.broadcast(known), "country", "left").withColumn(
        "region", F.coalesce("region", F.lit(OTHER_REGION))
    )


def with_demographics(df: DataFrame) -> DataFrame:
    """Add the synthetic channel and age group, both a function of the customer number."""
    key = F.col("customer_id")
    return df.withColumns({
        "acquisition_channel": weighted_choice(key, "channel", CHANNEL_SHARES),
        "age_group": weighted_choice(key, "age", AGE_SHARES),
    })


def dim_customers(
    lines: DataFrame, settings: Settings = DEFAULTS, *, position: str | None = None
) -> DataFrame:
    """One row per known customer with first-seen country and purchase dates (returns count).

    "First" needs an order: the position in the feed where the reader recorded it, else the
    purchase time with the invoice as tie-break.
    """
    day = F.to_date("invoice_date")
    seen = F.col(position) if position else F.struct("invoice_date", "invoice", "country")
    customers = (
        lines.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.min_by("country", F.when(F.col("country").isNotNull(), seen)).alias("country"),
            F.min(day).alias("first_purchase"),
            F.max(day).alias("last_purchase"),
        )
    )
    return with_demographics(with_region(customers, settings)).select(*DIM_CUSTOMERS.names)


# Lines of one day are numbered in this many independent buckets.
_DAY_BUCKETS = 64


def number_lines(
    lines: DataFrame, content: list[str], *, keep: list[str] | None = None, buckets: int = _DAY_BUCKETS
) -> DataFrame:
    """Add `transaction_id` 1..n, by day.

    A global sort of the fact only to number it would shuffle everything twice. Instead each day
    is cut into hash buckets over the `content` of the line, so a busy day, product or invoice is
    spread; the size of every (day, bucket) is counted, which is at most calendar days x buckets
    rows, and a row's id is what came before its bucket plus its place in it. The id depends on the
    content only, so a recomputed task assigns the same ones.

    `lines` are stored once with their buckets and places: counting and the final ids read the stored rows,
    so the joins that made `lines` run once, and what is stored needs no further shuffle of rows. Stored are the columns
    `keep` (all if not given), the bucket and the place in it; content and digest are not needed any more.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]
    digest = F.md5(F.concat_ws("|", *texts))
    bucket = F.conv(F.hex(F.substring("_digest", 1, 4)), 16, 10).cast("long") % F.lit(buckets)
    bucket = bucket.cast("int")
    keyed = lines.select(*(keep or lines.columns), F.unhex(digest).alias("_digest"))
    # The bucket follows from the digest, so the lines are moved without it.
    keyed = keyed.repartition("date_id", bucket).withColumn("_bucket", bucket)
    inside = Window.partitionBy("date_id", "_bucket").orderBy("_digest")
    placed = stage(keyed.withColumn("_place", F.row_number().over(inside)).drop("_digest"), "placed-lines")
    sizes = placed.groupBy("date_id", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("date_id", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "date_id", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    return (
        placed.join(F.broadcast(starts), ["date_id", "_bucket"])
        .withColumn("transaction_id", F.col("_before") + F.col("_place"))
        .drop("_bucket", "_before", "_place")
    )


# Up to this many customers that lines name and the dimension lacks, the lines stay where they are.
_STRANGERS = 100_000


def of_customers(lines: DataFrame, customers: DataFrame, *, most: int = _STRANGERS) -> DataFrame:
    """The lines whose customer is in `customers`.

    Few or no customers of the lines are missing from a dimension that was built from them. So only
    the distinct numbers are shuffled to find those, and their lines are dropped by a broadcast; where
    more than `most` are missing the lines are shuffled.
    """
    # Only whether a customer is there counts: without copies nothing else of the dimension is computed.
    numbers = customers.select("customer_id").distinct()
    known = lines.where(F.col("customer_id").isNotNull())
    strangers = cut(known.select("customer_id").distinct().join(numbers, "customer_id", "left_anti"))
    if strangers.count() <= most:
        return known.join(F.broadcast(strangers), "customer_id", "left_anti")
    return known.join(numbers, "customer_id", "left_semi")


def fact_transactions(
    lines: DataFrame,
    dates: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    *,
    buckets: int = _DAY_BUCKETS,
) -> DataFrame:
    """Lines of known customers with the keys of all dimensions.

    `buckets` is part of the numbering (see `number_lines`): raise it where days are very large.

    The calendar is broadcast by hint (one row per day), and so are the customers that are missing, if
    few (see `of_customers`, which reads `lines` once more). Products grow with the data: their join is
    left to size statistics and adaptive execution.
    """
    sold = of_customers(lines, customers).join(products.select("stock_code", "product_id"), "stock_code")
    # What follows from other columns is added after the lines were moved.
    keyed = (
        sold.withColumn("full_date", F.to_date("invoice_date"))
        .join(F.broadcast(dates.select("full_date", "date_id")), "full_date")
        .withColumn("unit_price", F.col("price").cast("decimal(10,2)"))
    )
    # The raw columns that the fact drops still help to tell lines apart when spreading them.
    numbered = number_lines(
        keyed,
        [c for c in CLEANED.names if c in keyed.columns],
        keep=["date_id", "invoice", "customer_id", "product_id", "quantity", "unit_price", "total_amount", "is_return"],
        buckets=buckets,
    )
    return numbered.select(
        "transaction_id",
        F.col("invoice").alias("invoice_no"),
        "customer_id",
        "product_id",
        "date_id",
        "quantity",
        "unit_price",
        "total_amount",
        "is_return",
    )


def build_star(
    lines: DataFrame, settings: Settings = DEFAULTS, *, position: str | None = None
) -> Star:
    dates = dim_dates(lines)
    customers = dim_customers(lines, settings, position=position)
    products = dim_products(lines)
    fact = fact_transactions(lines, dates, customers, products)
    return Star(fact=fact, dates=dates, customers=customers, products=products)
