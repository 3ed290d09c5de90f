from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillpath.operators import (
    cohorts,
    customers,
    features,
    geography,
    pareto,
    summary,
    trends,
    welch,
)

# Two customers with sales and returns, one with a single purchase, one with returns only.
LINES = [
    ("1", 1, 10, "2020-01-05", 2, 10.0),
    ("1", 1, 11, "2020-01-05", 1, 5.0),
    ("2", 1, 10, "2020-03-05", 1, 10.0),
    ("C3", 1, 10, "2020-06-30", -1, 10.0),
    ("4", 2, 11, "2020-03-10", 4, 5.0),
    ("5", 3, 12, "2020-01-20", 1, 0.5),
    ("6", 3, 12, "2020-04-20", 1, 50.0),
    ("C7", 4, 12, "2020-04-21", -1, 50.0),
]


@pytest.fixture(scope="module")
def star(make_star):
    return make_star(LINES, last="2020-12-31")


def test_monthly_lag_counts_rows_not_calendar_months(star):
    got = trends.revenue_monthly(star.fact, star.dates).orderBy("year", "month").collect()
    assert [(r["month"], float(r["revenue"])) for r in got] == [(1, 25.5), (3, 30.0), (4, 50.0)]
    assert [r["mom_growth_pct"] for r in got] == [None, 17.65, 66.67]
    assert [float(r["cumulative_revenue"]) for r in got] == [25.5, 55.5, 105.5]
    assert [r["active_customers"] for r in got] == [2, 2, 1]
    assert [r["order_count"] for r in got] == [2, 2, 1]
    assert {r["return_count"] for r in got} == {0} and {r["yoy_revenue"] for r in got} == {None}


def test_quarters_and_granularity(star):
    quarters = trends.revenue_quarterly(star.fact, star.dates).orderBy("quarter").collect()
    assert [(r["quarter"], r["active_customers"], r["revenue_per_customer"]) for r in quarters] == [
        (1, 3, 18.5), (2, 1, 50.0),
    ]
    trend = trends.revenue_trend(star.fact, star.dates, "quarterly").orderBy("month").collect()
    assert [(r["month"], r["mom_growth_pct"]) for r in trend] == [(1, None), (2, -9.91)]
    with pytest.raises(ValueError, match="granularity"):
        trends.revenue_trend(star.fact, star.dates, "daily")


def test_cohorts(star):
    got = cohorts.cohort_retention(star.fact, star.dates, star.customers)
    assert rows(got) == [
        ("2020-01", 2, 0, 2, 100.0),
        ("2020-01", 2, 2, 1, 50.0),
        ("2020-01", 2, 3, 1, 50.0),
        ("2020-03", 1, 0, 1, 100.0),
    ]
    matrix = {r["cohort"]: r for r in cohorts.cohort_matrix(got).collect()}
    assert matrix["2020-01"]["m2"] == 50.0 and matrix["2020-01"]["m1"] is None
    assert matrix["2020-03"]["m12"] is None
    # The customer with returns only has no active month, so its cohort is absent.
    assert "2020-04" not in matrix


def test_pareto(star):
    got = pareto.pareto_products(star.fact, star.products, partitions=2).orderBy("rank").collect()
    assert [(r["stock_code"], float(r["revenue"]), r["units_sold"], r["unique_buyers"]) for r in got] == [
        ("S12", 50.5, 2, 1), ("S10", 30.0, 3, 1), ("S11", 25.0, 5, 2),
    ]
    assert [r["cumulative_pct"] for r in got] == [47.87, 76.3, 100.0]
    assert [r["product_pct"] for r in got] == [33.33, 66.67, 100.0]
    point = pareto.pareto_point(pareto.pareto_products(star.fact, star.products)).first()
    assert (point["rank_at_level"], point["pct_by_rank"], point["pct_by_index"]) == (3, 100.0, 66.67)
    few = pareto.pareto_customers(star.fact, share=25.0, at_least=1).collect()
    assert [(r["rank"], r["customer_id"]) for r in few] == [(1, 3)]


def test_geography(star):
    places = geography.geo_breakdown(star.fact, star.customers)
    assert rows(places.select("country", "customers", "orders", "revenue_per_customer")) == [
        ("France", 2, 5, 42.75), ("Japan", 2, 2, 10.0),
    ]
    assert rows(geography.region_rollup(places).select("region", "customers")) == [
        ("Asia Pacific", 2), ("Europe", 2),
    ]
    assert geography.country_share(places, "Japan").first()["share_pct"] == 18.96
    assert geography.country_share(places, "Chile").first()["share_pct"] == 0.0


def test_lifetime_value(star):
    got = {r["customer_id"]: r for r in customers.customer_ltv(star.fact, star.dates, star.customers).collect()}
    one = got[1]
    assert (float(one["gross_revenue"]), float(one["return_value"]), float(one["net_revenue"])) == (35.0, -10.0, 25.0)
    assert (one["total_orders"], one["return_orders"], one["active_days"]) == (3, 1, 3)
    assert (one["avg_order_value"], one["tenure_days"], one["tenure_bucket"]) == (17.5, 177, "3-6 Months")
    assert one["monthly_revenue_rate"] == 4.24
    assert (got[2]["tenure_bucket"], got[2]["monthly_revenue_rate"]) == ("Single Purchase", 20.0)
    assert got[4]["avg_order_value"] is None and float(got[4]["net_revenue"]) == -50.0


def test_tenure_summary(star):
    got = {r["tenure_bucket"]: r for r in customers.tenure_summary(star.fact, star.customers).collect()}
    assert set(got) == {"3-6 Months", "Single Purchase"}
    single = got["Single Purchase"]
    assert (single["customer_count"], single["avg_clv"], single["median_clv"]) == (2, -15.0, -15.0)
    assert got["3-6 Months"]["avg_orders"] == 2.5


def test_rfm(star):
    got = customers.rfm_scores(star.fact, star.dates, partitions=2)
    # Customer 4 only returned and is left out.
    assert rows(got.select("customer_id", "recency_days", "frequency")) == [
        (1, 184, 2), (2, 296, 1), (3, 255, 2),
    ]
    assert rows(got.select("customer_id", "rfm_segment", "rfm_total")) == [
        (1, "3-2-2", 7), (2, "1-1-1", 3), (3, "2-3-3", 8),
    ]
    ends = customers.rfm_extremes(got, 1).collect()
    assert [(r["side"], r["customer_id"]) for r in ends] == [("top", 3), ("bottom", 2)]
    assert customers.rfm_summary(got).count() == 3


def test_ntile_sizes_differ_by_one_at_most(spark):
    values = spark.range(1003).select(
        F.col("id").alias("customer_id"), (F.col("id") % 7).cast("int").alias("recency_days"),
        F.lit(1).cast("long").alias("frequency"), F.col("id").cast("decimal(22,2)").alias("monetary"),
    )
    scored = customers.score_rfm(values, partitions=5)
    for column in ("r_score", "f_score", "m_score"):
        sizes = [r["count"] for r in scored.groupBy(column).count().collect()]
        assert sorted(sizes) == [200, 200, 201, 201, 201]


def test_churn_metrics_and_reference_date(star):
    got = {r["customer_id"]: r for r in customers.churn_metrics(
        star.fact, star.dates, star.customers, reference_date=dt.date(2020, 7, 10)).collect()}
    assert got[1]["days_since_last"] == 10 and not got[1]["is_churned"]
    assert got[2]["is_churned"] and got[2]["avg_txn_value"] == 20.0
    assert got[4]["avg_txn_value"] is None and got[4]["return_rate"] == 1.0
    split = customers.churn_split(customers.churn_metrics(star.fact, star.dates, star.customers)).first()
    assert (split["churned"], split["retained"], split["churn_pct"]) == (4, 0, 100.0)


@pytest.mark.parametrize(
    ("t", "df", "p"),
    [(2.228139, 10, 0.05), (1.959964, 1e9, 0.05), (12.7062, 1, 0.05), (3.169273, 10, 0.01), (0.0, 5, 1.0)],
)
def test_student_tail(spark, t, df, p):
    tails = spark.createDataFrame([(t, float(df)), (-t, float(df))], "t double, df double")
    for row in tails.select(welch.two_sided_p(F.col("t"), F.col("df")).alias("p")).collect():
        assert row["p"] == pytest.approx(p, abs=2e-6)


def test_student_tail_equals_an_integral(spark):
    """Against the density integrated over the angle, where no gamma function is needed."""
    import numpy as np

    cases = [(t, df) for df in (0.7, 1.0, 2.5, 9.0, 40.3, 333.0, 20000.0) for t in (1e-3, 0.3, 1.1, 2.7, 6.0, 30.0)]
    rows_ = spark.createDataFrame(cases, "t double, df double")
    got = rows_.select("t", "df", welch.two_sided_p(F.col("t"), F.col("df")).alias("p")).collect()

    def integral(low, df):
        # Tanh-sinh nodes settle at both ends of the range.
        u = np.linspace(-4.5, 4.5, 20001)
        inner = np.pi / 2 * np.sinh(u)
        reach = min(np.pi / 2, low + 60 / np.sqrt(df))
        at = low + (reach - low) / (1 + np.exp(-2 * inner))
        weight = (reach - low) * np.pi * np.cosh(u) / (2 * np.cosh(inner) ** 2) / 2
        return np.sum(np.cos(np.minimum(at, np.pi / 2)) ** (df - 1) * weight)

    for r in got:
        want = integral(np.arctan(r["t"] / np.sqrt(r["df"])), r["df"]) / integral(0.0, r["df"])
        assert r["p"] == pytest.approx(want, rel=2e-4 if r["df"] < 1 else 1e-7, abs=1e-12), (r["t"], r["df"])
    none = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 3.0), (1.0, 0.0)], "t double, df double")
    assert all(np.isnan(r[0]) for r in none.select(welch.two_sided_p(F.col("t"), F.col("df"))).collect())


def test_welch(spark):
    values = [(False, float(x)) for x in (3, 4, 5, 6, 7)] + [(True, float(x)) for x in (1, 2, 2, 3)]
    df = spark.createDataFrame([*values, (True, None)], "is_churned boolean, order_count double")
    got = welch.welch_tests(df, ("order_count",)).first()
    # By hand: means 5 and 2, variances 2.5 and 2/3, t = 3 / sqrt(0.5 + 1/6).
    assert (got["retained_mean"], got["churned_mean"], got["t_statistic"]) == (5.0, 2.0, 3.6742)
    assert got["significant"] and 0.005 < got["p_value"] < 0.012
    assert got["interpretation"].startswith("Retained customers have higher order_count (p=0.0")
    same = df.where("order_count IS NOT NULL").withColumn("order_count", F.lit(1.0))
    assert welch.welch_tests(same, ("order_count",)).first()["t_statistic"] is None


def test_purchase_trend_and_features(star):
    got = {r["customer_id"]: r for r in features.churn_features(star.fact, star.dates, star.customers).collect()}
    assert set(got) == {1, 2, 3}
    # Customer 1: 2020-01-05 .. 2020-06-30, midpoint 2020-04-02: both sales are early.
    assert got[1]["purchase_trend"] == -2
    assert got[2]["purchase_trend"] == 1
    assert got[3]["purchase_trend"] == 0
    assert (got[1]["days_active"], got[1]["tenure_days"], got[1]["order_count"]) == (177, 361, 2)
    assert got[1]["avg_items_per_order"] == pytest.approx(4 / 3)
    assert got[1]["return_rate"] == pytest.approx(1 / 3)
    trend = {r[0]: r[1] for r in features.purchase_trend(star.fact, star.dates, star.customers).collect()}
    assert trend == {1: -2, 2: 1, 3: 0, 4: 0}
    assert rows(features.product_diversity(star.fact)) == [(1, 2), (2, 1), (3, 1)]


def test_summary(star):
    got = summary.eda_summary(
        trends.revenue_monthly(star.fact, star.dates),
        cohorts.cohort_retention(star.fact, star.dates, star.customers),
        pareto.pareto_point(pareto.pareto_products(star.fact, star.products)),
        geography.country_share(geography.geo_breakdown(star.fact, star.customers), "France"),
        customers.churn_split(customers.churn_metrics(star.fact, star.dates, star.customers)),
    ).first()
    assert float(got["total_revenue"]) == 105.5 and got["peak_month"] == "2020-04"
    assert (got["avg_mom_growth"], got["avg_3month_retention"]) == (42.16, 50.0)
    assert (got["home_revenue_share"], got["churn_rate"]) == (81.04, 100.0)


def test_columns_are_pruned_at_the_scan(spark, tmp_path, star):
    star.fact.write.parquet(str(tmp_path / "fact"))
    stored = spark.read.parquet(str(tmp_path / "fact"))
    plan = trends.revenue_monthly(stored, star.dates)._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "unit_price" not in scan and "quantity" not in scan and "product_id" not in scan
    assert "is_return" in plan.split("PushedFilters: ")[1].split("]")[0]
