"""Queries next to their SQL twins on the smallest test tables."""

from __future__ import annotations

import os

import pytest

from checks import compare
from checks.oracles import ORACLES
from checks import planted  # noqa: F401  (adds its queries to both lists)
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
# One or two of every family; `python -m checks.compare` runs all of them.
CHOSEN = [
    "scan_parts_union", "full_refresh", "merge_segments", "cleaning_report", "clean_cast_customer",
    "dim_products", "dim_customers", "fact_transactions", "validation_report", "revenue_monthly",
    "cohort_retention", "pareto_products", "geo_breakdown", "customer_ltv", "tenure_summary",
    "rfm_scores", "welch_statistics", "eda_summary", "kpi_summary", "segment_names",
    "churn_features", "stratified_split", "evaluate_models", "threshold_sweep", "roc_points",
    "decompose", "anomalies", "forecast_scores", "history_plus_forecast", "feed_account", "star_pruned",
    "welch_p_values", "clean_odd_lines", "planted_clusters", "planted_logistic_regression", "planted_trend",
    "planted_forecast",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    problem, _, _ = compare.compare(spark, con, name, FOLDER)
    assert problem is None


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
