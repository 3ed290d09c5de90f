"""The exploratory report: all business tables and the one-row summary as files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.config import DEFAULTS, Settings
from tillpath.operators import cohorts, customers, geography, pareto, summary, trends, welch
from tillpath.schemas import Star
from tillpath.session import cut, scope
from tillpath.sources.reports import write_csv, write_json


def build_report(
    star: Star, home_country: str, settings: Settings = DEFAULTS
) -> dict[str, DataFrame]:
    """All report tables. Tables that others are computed from are kept, so each runs once."""
    monthly = cut(trends.revenue_monthly(star.fact, star.dates))
    retention = cut(cohorts.cohort_retention(star.fact, star.dates, star.customers))
    products = cut(pareto.pareto_products(star.fact, star.products))
    places = cut(geography.geo_breakdown(star.fact, star.customers))
    churn = cut(customers.churn_metrics(star.fact, star.dates, star.customers, settings))
    split = customers.churn_split(churn)
    return {
        "revenue_trends": monthly,
        "revenue_quarterly": trends.revenue_quarterly(star.fact, star.dates),
        "cohort_retention": retention,
        "cohort_matrix": cohorts.cohort_matrix(retention),
        "top_products": pareto.top_products(products),
        "geographic_breakdown": places,
        "region_rollup": geography.region_rollup(places),
        "tenure_summary": customers.tenure_summary(star.fact, star.customers),
        "churn_split": split,
        "churn_tests": welch.welch_tests(churn),
        "summary": summary.eda_summary(
            monthly,
            retention,
            pareto.pareto_point(products),
            geography.country_share(places, home_country),
            split,
        ),
    }


# The order of the rows in the files, falling by names with a minus; a table without one has one row.
ORDER: dict[str, list[str]] = {
    "revenue_trends": ["year", "month"],
    "revenue_quarterly": ["year", "quarter"],
    "cohort_retention": ["cohort", "period_number"],
    "cohort_matrix": ["cohort"],
    "top_products": ["rank"],
    "geographic_breakdown": ["-revenue", "country"],
    "region_rollup": ["-revenue", "region"],
    "tenure_summary": ["tenure_bucket"],
    "churn_tests": ["metric"],
}


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as a folder of files; read by name they are in the stated order."""
    for name, table in tables.items():
        path = os.path.join(folder, name)
        if name == "summary":
            write_json(table, path)
        else:
            order = [F.col(c).asc() if c[0] != "-" else F.col(c[1:]).desc() for c in ORDER.get(name, [])]
            write_csv(table.orderBy(*order) if order else table, path)


def run_report(star: Star, home_country: str, folder: str, settings: Settings = DEFAULTS) -> None:
    """Build and write all report tables; what they share on the way is removed at the end."""
    with scope(star.fact.sparkSession):
        write_report(build_report(star, home_country, settings), folder)


