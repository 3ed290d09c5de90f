from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillpath.operators import customers, selection
from tillpath.session import cut


def plain_groups(rows, groups):
    """ntile over rows sorted by (value, id)."""
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    small, large = divmod(len(rows), groups)
    out, at = {}, 0
    for g in range(1, groups + 1):
        for _ in range(small + (g <= large)):
            out[ordered[at][0]] = g
            at += 1
    return out


@pytest.mark.parametrize("groups", [2, 5, 10])
@pytest.mark.parametrize("bins", [4, 64])
def test_groups_equal_sorting(spark, groups, bins):
    draw = random.Random(groups * bins)
    ids = draw.sample(range(-500, 10**12), 400)
    shapes = {
        "flat": [7] * 400, "two": [draw.choice([-3, 10**15]) for _ in ids], "few": [draw.randrange(6) for _ in ids],
        "wide": [draw.randrange(-(2**60), 2**60) for _ in ids], "hot": [0 if draw.random() < 0.7 else draw.randrange(-50, 50) for _ in ids],
        "steep": [draw.randrange(2) * 2**draw.randrange(60) for _ in ids],
    }
    df = cut(spark.createDataFrame(list(zip(ids, *shapes.values())), "id long, " + ", ".join(f"{c} long" for c in shapes)))
    found = selection.bounds(df, {c: F.col(c) for c in shapes}, "id", groups, bins=bins)
    got = df.select("id", *[selection.group_of(F.col(c), F.col("id"), found[c]).alias(c) for c in shapes]).collect()
    for c, values in shapes.items():
        assert {r["id"]: r[c] for r in got} == plain_groups(list(zip(ids, values)), groups), c


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 6])
def test_fewer_rows_than_groups(spark, n):
    rows = [(i, i % 2) for i in range(n)]
    df = cut(spark.createDataFrame(rows, "id long, v int"))
    found = selection.bounds(df, {"v": selection.sortable(df, "v")}, "id", 5)
    got = df.select("id", selection.group_of(F.col("v"), F.col("id"), found["v"]).alias("g")).collect()
    assert {r["id"]: r["g"] for r in got} == plain_groups(rows, 5)


def test_decimals_keep_their_order(spark):
    values = [Decimal(v) for v in ("-12345678901234.56", "-0.01", "0.00", "0.01", "12345678901234.56")]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(22,2)")
    got = [r[0] for r in df.select(selection.sortable(df, "v")).collect()]
    assert got == [int(v * 100) for v in values]
    with pytest.raises(TypeError):
        selection.sortable(df.select(F.lit(1.5).alias("v")), "v")


def test_scores_sort_no_customers(spark):
    """No pass sorts customers: the only window runs over bins, and the scores are a projection of stored rows."""
    values = spark.range(20000).select(
        F.col("id").alias("customer_id"), (F.col("id") % 91).cast("int").alias("recency_days"),
        (F.col("id") % 3).alias("frequency"), (F.col("id") * 7 % 10007).cast("decimal(22,2)").alias("monetary"),
    )
    scored = customers.score_rfm(values)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    for node in ("Sort", "Exchange", "Window", "Join"):
        assert node not in plan
    for column, key in {"r_score": "-recency_days", "f_score": "frequency", "m_score": "monetary"}.items():
        wrong = scored.withColumn("want", F.expr(f"ntile(5) OVER (ORDER BY {key}, customer_id)")).where(f"{column} != want")
        assert wrong.count() == 0
