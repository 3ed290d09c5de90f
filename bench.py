"""Times the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the test tables (default sf0.1), BENCH_CPUS the local cores (default 8). Every
query runs over its whole tables and its result is computed completely (no-op sink).
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import testbed  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from tillpath.operators import (  # noqa: E402
    cohorts,
    customers,
    features,
    geography,
    pareto,
    series,
    trends,
)
from tillpath.plans.etl import run_etl  # noqa: E402
from tillpath.session import build_session  # noqa: E402
from tillpath.sources.feeds import union_parts  # noqa: E402
from tillpath.sources.tables import read_star  # noqa: E402

# What reads the star runs on the stored tables, as it would after a load; what cleans the feed reads the feed.
ON_STAR = {
    "revenue_monthly": lambda s: trends.revenue_monthly(s.fact, s.dates),
    "cohort_retention": lambda s: cohorts.cohort_retention(s.fact, s.dates, s.customers),
    "pareto_products": lambda s: pareto.pareto_products(s.fact, s.products),
    "geo_breakdown": lambda s: geography.geo_breakdown(s.fact, s.customers),
    "customer_ltv": lambda s: customers.customer_ltv(s.fact, s.dates, s.customers),
    "tenure_summary": lambda s: customers.tenure_summary(s.fact, s.customers),
    "rfm_scores": lambda s: customers.rfm_scores(s.fact, s.dates),
    "churn_features": lambda s: features.churn_features(
        s.fact, s.dates, s.customers, testbed.feature_table(customers.rfm_values(s.fact, s.dates))
    ),
}
ON_FEED = ["clean_cast_customer", "cleaning_report"]
ON_SERIES = {
    "walk_forward_folds": lambda g: series.walk_forward_folds(g.select("series_key", "month", "value")),
    "forecast_scores": lambda g: series.forecast_scores(series.baseline_forecasts(g)),
}


def country_grid(star):
    monthly = series.series_by_country(star.fact, star.dates, star.customers)
    return series.regular_grid(series.drop_truncated_month(monthly))


def timed(job) -> float:
    start = time.monotonic()
    job()
    return round(time.monotonic() - start, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--folder", help="where stored tables go (default: a temporary folder)")
    args = parser.parse_args()
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": cores,
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up cost of the JVM is not what is measured: every code path runs once on the smallest
    # tables, or on the measured ones where those are missing.
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    small = small if os.path.isdir(small) else folder
    scratch = args.folder or tempfile.mkdtemp(prefix="tillpath-bench-")

    def run(where: str, place: str) -> dict[str, float]:
        found = {}
        # The join of the test tables that makes the star is not part of any query.
        found["store_star"] = timed(lambda: testbed.stored_star(spark, where, os.path.join(scratch, place)))
        star = read_star(spark, os.path.join(scratch, place))
        for name, query in ON_STAR.items():
            found[name] = timed(lambda: drain(query(star)))
        for name in ON_FEED:
            found[name] = timed(lambda: drain(QUERIES[name](spark, where)))
        for name, query in ON_SERIES.items():
            found[name] = timed(lambda: drain(query(country_grid(star))))
        return found

    run(small, "warm-star")
    run_etl(union_parts(testbed.raw_parts(spark, small)), os.path.join(scratch, "warm-etl"))
    seconds = run(folder, "star")
    root = os.path.join(scratch, "etl")
    raw = union_parts(testbed.raw_parts(spark, folder))
    outcome = []
    seconds["etl_end_to_end"] = timed(lambda: outcome.append(run_etl(raw, root)))
    rows = raw.count()
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "etl_rows_per_sec": round(rows / seconds["etl_end_to_end"]),
        "etl_success": outcome[0].success,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
