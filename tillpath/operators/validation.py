"""Checks on the loaded star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.schemas import Star


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_row_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Per table: stored rows against the rows the load reported."""
    return _union([
        df.agg(F.count(F.lit(1)).alias("actual")).select(
            F.lit(name).alias("table_name"),
            F.lit(expected[name]).cast("long").alias("expected"),
            "actual",
            (F.col("actual") == expected[name]).alias("passed"),
        )
        for name, df in tables.items()
    ])


def check_orphans(star: Star) -> DataFrame:
    """Fact lines whose customer, product or day is missing in its dimension.

    Lines are counted per key before the join: a dimension key is looked up once, however many
    lines carry it.
    """
    sides = {
        "dim_customers": (star.customers, "customer_id"),
        "dim_products": (star.products, "product_id"),
        "dim_dates": (star.dates, "date_id"),
    }
    return _union([
        star.fact.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(dim.select(key), key, "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"))
        .select(
            F.lit(name).alias("dimension"),
            "orphan_rows",
            (F.col("orphan_rows") == 0).alias("passed"),
        )
        for name, (dim, key) in sides.items()
    ])


def check_null_customers(fact: DataFrame) -> DataFrame:
    nulls = F.count_if(F.col("customer_id").isNull())
    return fact.agg(nulls.alias("null_rows")).select(
        "null_rows", (F.col("null_rows") == 0).alias("passed")
    )


_KEYS = {"dim_customers": "customer_id", "dim_products": "product_id", "dim_dates": "date_id"}


def key_counts(star: Star) -> DataFrame:
    """(dimension, fact_rows, null_rows, orphan_rows, dim_rows), with the fact and each dimension read once.

    Every line gives its three keys as (dimension, key), counted before the shuffle; the keys of the dimensions
    are counted alike and meet them in one join.
    """
    stacked = star.fact.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.col(key).cast("long").alias("key")) for name, key in _KEYS.items()
    ])).alias("k")).select("k.*")
    used = stacked.groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))
    known = _union([
        dim.select(F.lit(name).alias("dimension"), F.col(_KEYS[name]).cast("long").alias("key"))
        for name, dim in (("dim_customers", star.customers), ("dim_products", star.products), ("dim_dates", star.dates))
    ]).groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("m"))
    met = used.join(known, ["dimension", "key"], "full_outer")

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    names = star.fact.sparkSession.createDataFrame([(d,) for d in _KEYS], "dimension string")
    counted = met.groupBy("dimension").agg(
        total(F.col("n")).alias("fact_rows"),
        total(F.when(F.col("key").isNull(), F.col("n"))).alias("null_rows"),
        total(F.when(F.col("m").isNull(), F.col("n"))).alias("orphan_rows"),
        total(F.col("m")).alias("dim_rows"),
    )
    # An empty table leaves no row of its dimension.
    return names.join(F.broadcast(counted), "dimension", "left").na.fill(0)


def validation_report(star: Star, expected: dict[str, int]) -> DataFrame:
    """All checks as (check, passed, details), from one pass over the fact (see `key_counts`)."""
    def count_check(name: str, actual: Column) -> Column:
        want = F.lit(expected[name]).cast("long")
        return F.struct(
            F.lit(f"row_count:{name}").alias("check"), (actual == want).alias("passed"),
            F.format_string("expected=%d, actual=%d", want, actual).alias("details"),
        )

    def none_check(name: str, found: Column, text: str) -> Column:
        return F.struct(
            F.lit(name).alias("check"), (found == 0).alias("passed"), F.format_string(f"{text}=%d", found).alias("details")
        )

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("dimension") == name, F.col(column)))

    facts = F.max("fact_rows")
    checks = [
        *[count_check(name, of(name, "dim_rows")) for name in ("dim_dates", "dim_products", "dim_customers")],
        count_check("fact_transactions", facts),
        *[none_check(f"fk_integrity:{name}", of(name, "orphan_rows"), "orphan_rows") for name in _KEYS],
        none_check("no_null_customer_id_in_fact", of("dim_customers", "null_rows"), "null_customer_rows"),
    ]
    return key_counts(star).agg(F.array(*checks).alias("c")).select(F.inline("c"))


def all_passed(report: DataFrame) -> DataFrame:
    """One row: did every check pass."""
    return report.agg(
        F.bool_and("passed").alias("success"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("passed")).alias("failed"),
    )
