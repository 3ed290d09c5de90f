from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillpath import schemas
from tillpath.operators import merging
from tillpath.sources import feature_store as store


@pytest.fixture(scope="module")
def table(spark):
    names = {f.name: F.lit(None).cast(f.dataType) for f in schemas.CUSTOMER_FEATURES.fields}
    filled = names | {"customer_id": F.col("id"), "frequency": F.lit(3), "churn_label": F.col("id") % 2 == 0}
    types = {f.name: f.dataType for f in schemas.CUSTOMER_FEATURES.fields}
    return spark.range(500).select(*[filled[c].cast(types[c]).alias(c) for c in names])


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def segments(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "customer_id long").select(
        "customer_id", F.lit(1).alias("recency_days"), F.lit(9).alias("frequency"), F.lit("7.50").cast("decimal(12,2)").alias("monetary"),
        F.lit("5-5-5").alias("rfm_segment"), F.lit(2).alias("cluster_id"), F.lit("Fresh").alias("segment_name"),
    )


def test_a_merge_rewrites_the_buckets_it_touches_and_no_other(spark, table, tmp_path):
    path = str(tmp_path / "features")
    store.create(table, path, 32)
    assert rows(store.read(spark, path)) == rows(table)
    before = files(path)
    new = segments(spark, [7, 9000, 9001])
    touched = store.merge_segments_into(spark, path, new, 32)
    assert 1 <= len(touched) <= 3
    gone, made = before - files(path), files(path) - before
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in gone | made} <= set(touched)
    assert len(before & files(path)) >= 32 - len(touched)
    assert rows(store.read(spark, path)) == rows(merging.merge_segments(table, new))


def test_scores_and_empty_merges(spark, table, tmp_path):
    path = str(tmp_path / "features")
    store.create(table, path, 16)
    before = files(path)
    scores = spark.createDataFrame([(3, 0.25), (4, 0.75), (10**9, 0.5)], "customer_id long, churn_probability double")
    assert store.merge_scores_into(spark, path, scores.limit(0), 16) == [] and files(path) == before
    store.merge_scores_into(spark, path, scores, 16)
    assert rows(store.read(spark, path)) == rows(merging.merge_scores(table, scores))


def test_a_merge_that_fails_changes_nothing(spark, table, tmp_path):
    path = str(tmp_path / "features")
    store.create(table, path, 16)
    before = files(path)
    bad = segments(spark, [1, 2]).withColumn("segment_name", F.when(F.col("customer_id") == 2, F.raise_error(F.lit("broken"))).otherwise("x"))
    with pytest.raises(Exception, match="broken"):
        store.merge_segments_into(spark, path, bad, 16)
    assert files(path) == before and rows(store.read(spark, path)) == rows(table)
