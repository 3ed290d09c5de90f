from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from tillpath.functions.numeric import ntile
from tillpath.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """1,000 rows of which a third share one value, in two groups of very different size."""
    random.seed(5)
    data = [
        (i, "big" if i % 10 else "small", Decimal(7) if i % 3 == 0 else Decimal(random.randint(1, 40)))
        for i in range(1000)
    ]
    return spark.createDataFrame(data, "id long, grp string, v decimal(12,2)").repartition(5)


@pytest.mark.parametrize("partitions", [1, 3, 8, None])
def test_dense_key_is_row_number(skewed, partitions):
    got = ranking.dense_key(skewed, [F.col("v").desc(), "id"], "k", total="n", partitions=partitions)
    want = skewed.select(
        "*",
        F.row_number().over(Window.orderBy(F.col("v").desc(), "id")).cast("long").alias("k"),
        F.lit(1000).cast("long").alias("n"),
    )
    assert rows(got) == rows(want)


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_group_key_is_row_number_per_group(skewed, partitions):
    got = ranking.group_key(skewed, ["grp"], ["v", "id"], "k", total="n", partitions=partitions)
    w = Window.partitionBy("grp")
    want = skewed.select(
        "*",
        F.row_number().over(w.orderBy("v", "id")).cast("long").alias("k"),
        F.count(F.lit(1)).over(w).alias("n"),
    )
    assert rows(got) == rows(want)


@pytest.mark.parametrize("partitions", [1, 3, 8, None])
def test_running_totals(skewed, partitions):
    got = ranking.running_totals(
        skewed, ["v", "id"], {"v": "upto"}, rank="k", count="n", grand={"v": "whole"},
        partitions=partitions,
    )
    w = Window.orderBy("v", "id")
    want = skewed.select(
        "*",
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.row_number().over(w).cast("long").alias("k"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
        F.sum("v").over(Window.partitionBy()).alias("whole"),
    )
    assert rows(got) == rows(want)


@pytest.mark.parametrize("partitions", [1, 3, 8, 40])
def test_concentration_shares_ties_like_a_range_frame(skewed, partitions):
    got = ranking.concentration(skewed, "v", ["id"], partitions=partitions)
    want = skewed.select(
        "*",
        F.row_number().over(Window.orderBy(F.col("v").desc(), "id")).cast("long").alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n_rows"),
        F.sum("v").over(Window.orderBy(F.col("v").desc())).alias("cumulative_value"),
        F.sum("v").over(Window.partitionBy()).alias("total_value"),
    )
    assert rows(got) == rows(want)


def test_concentration_where_all_values_are_equal(spark):
    same = spark.range(50).select("id", F.lit(Decimal(2)).cast("decimal(12,2)").alias("v"))
    got = ranking.concentration(same, "v", ["id"], partitions=6)
    assert {r["cumulative_value"] for r in got.collect()} == {Decimal(100)}
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 51))


@pytest.mark.parametrize("partitions", [1, 4, None])
def test_exact_quantiles(skewed, partitions):
    shares = {"q01": 0.01, "q50": 0.5, "q99": 0.99}
    got = ranking.exact_quantiles(skewed, "v", shares, group=["grp"], partitions=partitions)
    frame = skewed.toPandas()
    assert got.count() == 2
    for row in got.collect():
        values = frame[frame.grp == row["grp"]].v.astype(float)
        for name, share in shares.items():
            assert row[name] == pytest.approx(np.quantile(values, share))
    overall = ranking.exact_quantiles(skewed, "v", {"m": 0.5}).first()
    assert overall["m"] == pytest.approx(np.quantile(frame.v.astype(float), 0.5))


def test_quantiles_skip_nulls_and_keep_a_null_group(spark):
    df = spark.createDataFrame(
        [(None, 1), (None, 3), ("a", None), ("a", 5)], "g string, v int"
    )
    assert rows(ranking.exact_quantiles(df, "v", {"m": 0.5}, group=["g"])) == [("a", 5.0), (None, 2.0)]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id long, v decimal(12,2)")
    assert ranking.dense_key(empty, ["id"], "k").count() == 0
    assert ranking.concentration(empty, "v", ["id"]).count() == 0
    # A global aggregate has its row on empty input, too, as in SQL.
    assert ranking.exact_quantiles(empty, "v", {"m": 0.5}).first()["m"] is None


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 12, 13, 99, 100])
def test_ntile_from_rank(spark, n):
    got = spark.range(1, n + 1).select(
        ntile(F.col("id"), F.lit(n), 5).alias("ours"),
        F.ntile(5).over(Window.orderBy("id")).alias("sql"),
    ).collect()
    assert all(r["ours"] == r["sql"] for r in got)


def test_only_slice_summaries_meet_in_one_task(skewed):
    """Every single-partition exchange of the plan sits above an aggregate per slice."""
    ranked = ranking.dense_key(skewed, ["v", "id"], "k")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan
    before_single = plan.split("SinglePartition")[1:]
    assert before_single and all("keys=[_slice" in part for part in before_single)
