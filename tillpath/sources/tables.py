"""Star tables as Parquet, published version by version."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath import schemas
from tillpath.schemas import Star
from tillpath.session import create_empty, listed, remove

TABLES = {
    "dim_dates": schemas.DIM_DATES,
    "dim_customers": schemas.DIM_CUSTOMERS,
    "dim_products": schemas.DIM_PRODUCTS,
}
_PARTITION = ["year", "month"]
FACT_STORED = T.StructType(
    [*schemas.FACT.fields, *[T.StructField(c, T.IntegerType()) for c in _PARTITION]]
)


# Markers of published versions, one empty file each; Spark's readers pass over names with a leading underscore.
_PUBLISHED = "_published"
# Published versions that stay: the current one and the one that readers may still be in.
_KEPT = 2


def _markers(spark: SparkSession, path: str) -> list[str]:
    """Names `<number>.<version>` of what was published at `path`, oldest first."""
    try:
        return sorted(os.path.basename(m) for m in listed(spark, os.path.join(path, _PUBLISHED)))
    except FileNotFoundError:
        return []


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version of the table at `path` that was published last."""
    found = _markers(spark, path)
    if not found:
        raise FileNotFoundError(f"no table was published at {path}")
    return os.path.join(path, found[-1].split(".")[1])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(current(spark, path))


def full_refresh(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Replace the table at `path` by `df` and return the rows written.

    The rows go to a folder of their own, which becomes the table when all of them are there: an empty file with
    its name is created, which is one step on any storage. A load that fails leaves the old table as it is
    and removes what it wrote; readers meanwhile see the old version, which stays for one more load. Of two loads at
    the same time the one with the greater marker counts. `df` may read the table at `path`.

    The count is observed while writing, so there is no second pass.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    rows = Observation("rows")
    writer = df.observe(rows, F.count(F.lit(1)).alias("n")).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.parquet(os.path.join(path, version))
    except BaseException:
        remove(spark, os.path.join(path, version))
        raise
    before = _markers(spark, path)
    number = int(before[-1].split(".")[0]) + 1 if before else 1
    create_empty(spark, os.path.join(path, _PUBLISHED, f"{number:012d}.{version}"))
    for marker in before[: len(before) + 1 - _KEPT]:
        # The marker first: a version without one is no table, whereas the other way round would name a missing one.
        remove(spark, os.path.join(path, _PUBLISHED, marker))
        remove(spark, os.path.join(path, marker.split(".")[1]))
    return int(rows.get["n"])


def write_fact(fact: DataFrame, dates: DataFrame, path: str) -> int:
    """Write the fact by year and month.

    Rows are brought together by month before writing. Rebalancing lets adaptive execution split a
    busy month over several tasks and put quiet ones together, so files are of even size.
    """
    calendar = dates.select("date_id", *_PARTITION)
    lines = fact.select(*schemas.FACT.names)
    dated = lines.join(F.broadcast(calendar), "date_id").select(*schemas.FACT.names, *_PARTITION)
    return full_refresh(dated.hint("rebalance", *_PARTITION), path, _PARTITION)


def write_dimension(df: DataFrame, root: str, name: str) -> tuple[DataFrame, int]:
    """Write one dimension; the stored table and its rows."""
    path = os.path.join(root, name)
    rows = full_refresh(df.select(*TABLES[name].names), path)
    return read_table(df.sparkSession, path, TABLES[name]), rows


def read_star(spark: SparkSession, root: str) -> Star:
    """The stored star.

    The fact keeps `year` and `month`: filters on them prune folders, and a join with a filtered calendar on
    `date_id`, `year` and `month` prunes them at run time (`orders.with_calendar` joins so).
    """
    def table(name: str, schema: T.StructType) -> DataFrame:
        return read_table(spark, os.path.join(root, name), schema)

    return Star(
        fact=table("fact_transactions", FACT_STORED),
        **{name.removeprefix("dim_"): table(name, schema) for name, schema in TABLES.items()},
    )


def register_views(star: Star) -> None:
    """Make the star available to `spark.sql`."""
    star.fact.createOrReplaceTempView("fact_transactions")
    star.dates.createOrReplaceTempView("dim_dates")
    star.customers.createOrReplaceTempView("dim_customers")
    star.products.createOrReplaceTempView("dim_products")
