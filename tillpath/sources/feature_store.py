"""The customer feature table in buckets, of which a merge rewrites only those it touches.

A customer's bucket is a hash of the number, so buckets are of even size and a merge of few customers reads
and writes few of them. The rows of the other buckets stay in their files. A bucket is replaced when the write
commits (Spark's dynamic partition overwrite); a merge that fails before that changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath.operators.merging import merge_scores, merge_segments
from tillpath.schemas import CUSTOMER_FEATURES
from tillpath.session import scope, stage

BUCKETS = 256
_STORED = T.StructType([*CUSTOMER_FEATURES.fields, T.StructField("bucket", T.IntegerType())])


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long") if isinstance(key, str) else key), F.lit(buckets)).cast("int")


def _write(table: DataFrame, path: str, buckets: int, mode: str) -> None:
    keyed = table.withColumn("bucket", bucket_of("customer_id", buckets))
    # One task per bucket at most, so a bucket is one file unless it is large.
    keyed.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(
        "bucket"
    ).parquet(path)


def create(table: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store a whole feature table; what was at `path` goes."""
    _write(table.select(*CUSTOMER_FEATURES.names), path, buckets, "static")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path).select(*CUSTOMER_FEATURES.names)


def _merged(
    spark: SparkSession, path: str, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int
) -> list[int]:
    """Merge `incoming` into the table at `path`; the buckets that were rewritten."""
    with scope(spark):
        rows = stage(incoming.withColumn("_bucket", bucket_of("customer_id", buckets)), "incoming")
        # At most one row per bucket.
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())
        if not touched:
            return []
        # The filter is on the folder of a bucket: the others are not read.
        stored = spark.read.schema(_STORED).parquet(path)
        old = stored.where(F.col("bucket").isin(touched)).select(*CUSTOMER_FEATURES.names)
        # Kept apart before its own files are replaced.
        new = stage(merge(old, rows.drop("_bucket")), "merged")
        _write(new, path, buckets, "dynamic")
    return touched


def merge_segments_into(spark: SparkSession, path: str, segments: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """`merge_segments` on the stored table. `buckets` must be those it was created with."""
    return _merged(spark, path, segments, merge_segments, buckets)


def merge_scores_into(spark: SparkSession, path: str, scores: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """`merge_scores` on the stored table; scores of unknown customers are dropped."""
    return _merged(spark, path, scores, merge_scores, buckets)
