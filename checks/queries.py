"""One query per operator, over the test tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import testbed
from tillpath.config import Settings
from tillpath.fixed_values import NUMERIC_FEATURES
from tillpath.functions.numeric import half_up, risk_tier
from tillpath.operators import (
    classifiers,
    cleaning,
    cohorts,
    customers,
    features,
    forecasting,
    geography,
    merging,
    metrics,
    pareto,
    ranking,
    segments,
    series,
    serving,
    star as star_build,
    summary,
    trends,
    validation,
    welch,
)
from tillpath.operators.orders import with_calendar
from tillpath.schemas import Star
from tillpath.session import cut, shared_folder
from tillpath.sources import feeds, reports, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and timestamps (all at midnight) as dates, for comparison."""
    columns = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = column.cast("date")
        columns.append(column.alias(f.name))
    return df.select(*columns)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = lambda spark, folder: plain(function(spark, folder))
    return function


# ---- sources and sinks ------------------------------------------------------------------------

QUOTED = ' 16" X 24", RED'


def write_feed(part: DataFrame, path: str) -> None:
    """Add CSV files as a spreadsheet writes them: doubled quotes, spaces kept."""
    part.write.mode("append").options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


@query
def scan_parts_union(spark, folder):
    """The feed written as files and read back: the first part as CSV in one folder, where files have the columns in
    two orders and texts hold quotes and commas; the second as JSON, whose records leave NULL fields out."""
    first, second = (
        part.withColumn("Description", F.concat("Description", F.lit(QUOTED)))
        for part in testbed.raw_parts(spark, folder)
    )
    path = os.path.join(shared_folder(spark), f"feed-{uuid.uuid4().hex}")
    even = F.col("Quantity") % 2 == 0
    write_feed(first.where(even), f"{path}/csv")
    write_feed(first.where(~even).select(*reversed(first.columns)), f"{path}/csv")
    second.write.json(f"{path}/json")
    return feeds.union_parts(
        [feeds.read_parts(spark, [f"{path}/csv"]), feeds.read_parts(spark, [f"{path}/json"], "json")]
    )


@query
def feed_account(spark, folder):
    """The first part as CSV, where some texts hold a line break: read by lines, and read with line breaks in quotes."""
    first, _ = testbed.raw_parts(spark, folder)
    broken = F.concat("Description", F.lit("\n"), "StockCode")
    lines = first.withColumn("Description", F.when(F.col("Quantity") % 13 == 0, broken).otherwise(F.col("Description")))
    path = os.path.join(shared_folder(spark), f"feed-{uuid.uuid4().hex}")
    even = F.col("Quantity") % 2 == 0
    write_feed(lines.where(even), path)
    write_feed(lines.where(~even).select(*reversed(first.columns)), path)
    return feeds.feed_account(feeds.read_lines(spark, [path])).select(F.lit("lines").alias("reading"), "*").unionByName(
        feeds.feed_account(feeds.read_lines(spark, [path], multi_line=True)).select(F.lit("quoted").alias("reading"), "*")
    )


@query
def required_columns(spark, folder):
    """A feed with a column too many is read; one without prices is refused, in the words of `refusal`."""
    first, second = testbed.raw_parts(spark, folder)
    path = os.path.join(shared_folder(spark), f"feed-{uuid.uuid4().hex}")
    write_feed(first.withColumn("Till", F.lit(1)), f"{path}/more")
    write_feed(second, f"{path}/less")
    write_feed(second.drop("Price"), f"{path}/less")
    refusal = None
    try:
        feeds.read_parts(spark, [f"{path}/less"])
    except ValueError as problem:
        refusal = str(problem).split(", found")[0]
    return feeds.read_parts(spark, [f"{path}/more"]).groupBy("Country").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("Quantity").alias("quantity"),
        F.count("Customer ID").alias("n_known"),
        F.lit(refusal).alias("refusal"),
    )


@query
def full_refresh(spark, folder):
    """Write the fact twice to one place; the second load replaces the first."""
    path = os.path.join(shared_folder(spark), f"fact-{uuid.uuid4().hex}")
    dates = testbed.dates(spark, folder)
    lines = testbed.fact(spark, folder).withColumn("transaction_id", F.lit(0).cast("long"))
    tables.write_fact(lines, dates, path)
    written = tables.write_fact(lines, dates, path)
    stored = tables.read_table(spark, path, tables.FACT_STORED)
    return stored.groupBy("year", "month").agg(
        F.lit(written).cast("long").alias("rows_written"),
        F.count(F.lit(1)).alias("rows_read"),
        F.sum("total_amount").alias("amount"),
    )


@query
def star_scan(spark, folder):
    """The stored star through SQL text; the filter on the year leaves folders of the fact unread."""
    tables.register_views(testbed.stored_star(spark, folder))
    return spark.sql("""
        SELECT c.region, d.year, count(*) AS line_count, sum(f.total_amount) AS amount
        FROM fact_transactions f
        JOIN dim_dates d ON f.date_id = d.date_id
        JOIN dim_customers c ON f.customer_id = c.customer_id
        JOIN dim_products p ON f.product_id = p.product_id
        WHERE f.year >= 1995
        GROUP BY c.region, d.year
    """)


@query
def star_pruned(spark, folder):
    """The stored star by region, for the second quarters: the filter is on the calendar, and which folders of the fact
    are read is decided while the query runs."""
    stored = testbed.stored_star(spark, folder)
    lines = with_calendar(stored.fact, stored.dates.where("quarter = 2"), "year")
    return lines.join(stored.customers.select("customer_id", "region"), "customer_id").groupBy("region", "year").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("total_amount").alias("amount")
    )


@query
def report_csv(spark, folder):
    """A report written as CSV and read back with its schema."""
    table = trends.revenue_trend(testbed.fact(spark, folder), testbed.dates(spark, folder))
    path = os.path.join(shared_folder(spark), f"report-{uuid.uuid4().hex}")
    reports.write_csv(table, path)
    return reports.read_report(spark, path, table.schema)


@query
def report_json(spark, folder):
    table = eda_summary(spark, folder)
    path = os.path.join(shared_folder(spark), f"summary-{uuid.uuid4().hex}")
    reports.write_json(table, path)
    return spark.read.schema(table.schema).json(path)


def _values(spark, folder):
    return customers.rfm_values(testbed.fact(spark, folder), testbed.dates(spark, folder))


def _feature_table(spark, folder):
    return testbed.feature_table(_values(spark, folder))


def _merge_input(spark, folder):
    """Customers with an even number are already in the table."""
    values = cut(_values(spark, folder))
    old = testbed.feature_table(values.where(F.col("customer_id") % 2 == 0))
    return values, old


@query
def merge_segments(spark, folder):
    values, old = _merge_input(spark, folder)
    new = values.where(F.col("customer_id") % 3 != 0).select(
        "customer_id",
        (F.col("recency_days") + 1).alias("recency_days"),
        "frequency",
        "monetary",
        F.lit("5-5-5").alias("rfm_segment"),
        F.lit(9).alias("cluster_id"),
        F.lit("Fresh").alias("segment_name"),
    )
    return merging.merge_segments(old, new)


@query
def merge_scores(spark, folder):
    values, old = _merge_input(spark, folder)
    scores = values.where(F.col("customer_id") % 3 != 0).select(
        "customer_id",
        ((testbed.key_hash("customer_id") % 1000) / 1000.0).alias("churn_probability"),
    )
    return merging.merge_scores(old, scores)


# ---- cleaning ---------------------------------------------------------------------------------


def _raw(spark, folder):
    return feeds.union_parts(testbed.raw_parts(spark, folder))


def _stripped(spark, folder):
    return cleaning.strip_strings(cleaning.rename_columns(_raw(spark, folder)))


def _distinct(spark, folder):
    return cleaning.drop_duplicates(_stripped(spark, folder))


def _flagged(spark, folder):
    return cleaning.flag_returns(_distinct(spark, folder))


def _kept(spark, folder):
    kept = cleaning.drop_bad_prices(cleaning.drop_non_products(_flagged(spark, folder)))
    return cleaning.drop_zero_quantity(kept)


def _lines(spark, folder):
    return cleaning.clean_transactions(_raw(spark, folder)).lines


@query
def clean_rename(spark, folder):
    return cleaning.rename_columns(_raw(spark, folder))


@query
def clean_strip(spark, folder):
    return _stripped(spark, folder)


@query
def clean_dedup(spark, folder):
    return _distinct(spark, folder)


@query
def clean_flag_returns(spark, folder):
    return _flagged(spark, folder)


@query
def clean_non_products(spark, folder):
    return cleaning.drop_non_products(_flagged(spark, folder))


@query
def clean_prices(spark, folder):
    return cleaning.drop_bad_prices(cleaning.drop_non_products(_flagged(spark, folder)))


@query
def clean_zero_qty(spark, folder):
    return _kept(spark, folder)


@query
def clean_cap_qty(spark, folder):
    kept = cut(_kept(spark, folder))
    return cleaning.cap_quantity(kept, cleaning.quantity_bounds(kept))


@query
def clean_total(spark, folder):
    kept = cut(_kept(spark, folder))
    return cleaning.add_total(cleaning.cap_quantity(kept, cleaning.quantity_bounds(kept)))


@query
def clean_cast_customer(spark, folder):
    return cleaning.clean_transactions(_raw(spark, folder)).lines


@query
def cleaning_report(spark, folder):
    return cleaning.clean_transactions(_raw(spark, folder)).report


# ---- star schema build ------------------------------------------------------------------------


@query
def dim_dates(spark, folder):
    return star_build.dim_dates(_lines(spark, folder))


@query
def dim_products(spark, folder):
    return star_build.dim_products(_lines(spark, folder))


@query
def dim_customers(spark, folder):
    return star_build.dim_customers(_lines(spark, folder))


@query
def region_map(spark, folder):
    places = _lines(spark, folder).select("country")
    return star_build.with_region(places).groupBy("country", "region").agg(
        F.count(F.lit(1)).alias("line_count")
    )


@query
def weighted_choice(spark, folder):
    keys = testbed.table(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id"))
    return star_build.with_demographics(keys)


@query
def fact_transactions(spark, folder):
    return star_build.build_star(_lines(spark, folder)).fact


@query
def dense_key(spark, folder):
    parts = testbed.table(spark, folder, "part").select("p_partkey", "p_name")
    return ranking.dense_key(parts, ["p_name", "p_partkey"], "name_id")


# ---- validation -------------------------------------------------------------------------------


def _damaged(spark, folder) -> Star:
    """The star with every tenth customer and every 16th product missing."""
    whole = testbed.star(spark, folder)
    return Star(
        fact=whole.fact,
        dates=whole.dates,
        customers=whole.customers.where(F.col("customer_id") % 10 != 0),
        products=whole.products.where(F.col("product_id") % 16 != 0),
    )


def _counted(whole: Star) -> tuple[dict[str, DataFrame], dict[str, int]]:
    stored = {
        "dim_dates": whole.dates,
        "dim_products": whole.products,
        "dim_customers": whole.customers,
        "fact_transactions": whole.fact,
    }
    return stored, {name: df.count() for name, df in stored.items()}


@query
def check_row_counts(spark, folder):
    """Expected counts from the whole star, stored tables from the damaged one."""
    _, expected = _counted(testbed.star(spark, folder))
    damaged = _damaged(spark, folder)
    stored = {
        "dim_dates": damaged.dates,
        "dim_products": damaged.products,
        "dim_customers": damaged.customers,
        "fact_transactions": damaged.fact,
    }
    return validation.check_row_counts(stored, expected)


@query
def check_orphans(spark, folder):
    return validation.check_orphans(_damaged(spark, folder))


@query
def check_null_keys(spark, folder):
    lines = testbed.fact(spark, folder)
    return validation.check_null_customers(
        lines.withColumn("customer_id", F.nullif(F.col("customer_id") % 7, F.lit(0)))
    )


@query
def validation_report(spark, folder):
    _, expected = _counted(testbed.star(spark, folder))
    return validation.validation_report(_damaged(spark, folder), expected)


# ---- business analytics -----------------------------------------------------------------------


@query
def revenue_monthly(spark, folder):
    return trends.revenue_monthly(testbed.fact(spark, folder), testbed.dates(spark, folder))


@query
def revenue_quarterly(spark, folder):
    return trends.revenue_quarterly(testbed.fact(spark, folder), testbed.dates(spark, folder))


@query
def revenue_trend(spark, folder):
    """Both granularities."""
    lines, dates = testbed.fact(spark, folder), testbed.dates(spark, folder)
    return trends.revenue_trend(lines, dates, "monthly").select(
        F.lit("monthly").alias("granularity"), "*"
    ).unionByName(
        trends.revenue_trend(lines, dates, "quarterly").select(
            F.lit("quarterly").alias("granularity"), "*"
        )
    )


def _retention(spark, folder):
    s = testbed.star(spark, folder)
    return cohorts.cohort_retention(s.fact, s.dates, s.customers)


@query
def cohort_retention(spark, folder):
    return _retention(spark, folder)


@query
def cohort_matrix(spark, folder):
    return cohorts.cohort_matrix(_retention(spark, folder))


def _pareto(spark, folder):
    return pareto.pareto_products(testbed.fact(spark, folder), testbed.products(spark, folder))


@query
def pareto_products(spark, folder):
    return _pareto(spark, folder)


@query
def top_products(spark, folder):
    return pareto.top_products(_pareto(spark, folder))


@query
def pareto_customers(spark, folder):
    return pareto.pareto_customers(testbed.fact(spark, folder))


@query
def pareto_point(spark, folder):
    return pareto.pareto_point(_pareto(spark, folder))


@query
def global_cumsum(spark, folder):
    lines = testbed.table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(12,2)").alias("price")
    )
    return ranking.running_totals(
        lines, ["o_orderdate", "o_orderkey"], {"price": "running_price"},
        rank="position", count="n_rows", grand={"price": "all_price"},
    ).select("o_orderkey", "position", "running_price", "n_rows", "all_price")


def _places(spark, folder):
    return geography.geo_breakdown(testbed.fact(spark, folder), testbed.customers(spark, folder))


@query
def geo_breakdown(spark, folder):
    return _places(spark, folder)


@query
def region_rollup(spark, folder):
    return geography.region_rollup(_places(spark, folder))


@query
def country_share(spark, folder):
    return geography.country_share(_places(spark, folder), testbed.HOME)


@query
def customer_ltv(spark, folder):
    s = testbed.star(spark, folder)
    return customers.customer_ltv(s.fact, s.dates, s.customers)


@query
def tenure_summary(spark, folder):
    return customers.tenure_summary(testbed.fact(spark, folder), testbed.customers(spark, folder))


def _scores(spark, folder):
    return customers.rfm_scores(testbed.fact(spark, folder), testbed.dates(spark, folder))


@query
def rfm_scores(spark, folder):
    return _scores(spark, folder)


@query
def rfm_summary(spark, folder):
    return customers.rfm_summary(_scores(spark, folder))


@query
def rfm_top_bottom(spark, folder):
    return customers.rfm_extremes(cut(_scores(spark, folder)))


def _churn_metrics(spark, folder):
    s = testbed.star(spark, folder)
    return customers.churn_metrics(s.fact, s.dates, s.customers)


@query
def churn_metrics(spark, folder):
    return _churn_metrics(spark, folder)


@query
def churn_split(spark, folder):
    return customers.churn_split(_churn_metrics(spark, folder))


@query
def welch_statistics(spark, folder):
    """Sizes, means, t and degrees of freedom."""
    found = welch.welch_statistics(_churn_metrics(spark, folder))
    return found.select(
        "metric",
        "retained_n",
        "churned_n",
        half_up(F.col("retained_avg")).alias("retained_mean"),
        half_up(F.col("churned_avg")).alias("churned_mean"),
        half_up(F.col("t"), 4).alias("t_statistic"),
        half_up(F.col("df"), 4).alias("df"),
    )


@query
def welch_tests(spark, folder):
    return welch.welch_tests(_churn_metrics(spark, folder))


@query
def eda_summary(spark, folder):
    s = testbed.star(spark, folder)
    return summary.eda_summary(
        trends.revenue_monthly(s.fact, s.dates),
        cohorts.cohort_retention(s.fact, s.dates, s.customers),
        pareto.pareto_point(pareto.pareto_products(s.fact, s.products)),
        geography.country_share(geography.geo_breakdown(s.fact, s.customers), testbed.HOME),
        customers.churn_split(customers.churn_metrics(s.fact, s.dates, s.customers)),
    )


# ---- serving ----------------------------------------------------------------------------------


@query
def kpi_summary(spark, folder):
    return serving.kpi_summary(testbed.fact(spark, folder), _feature_table(spark, folder))


@query
def segment_summary(spark, folder):
    return serving.segment_summary(_feature_table(spark, folder))


@query
def segment_share(spark, folder):
    return serving.segment_share(serving.segment_summary(_feature_table(spark, folder)))


@query
def churn_risk_page(spark, folder):
    """Second page of medium risk in one segment, with the total."""
    page = serving.churn_risk_page(
        _feature_table(spark, folder), tier="medium", segment="Segment 1", page=2, limit=20
    )
    return page.rows.crossJoin(F.broadcast(page.total))


@query
def revenue_history(spark, folder):
    return trends.revenue_history(testbed.fact(spark, folder), testbed.dates(spark, folder))


def _grid(spark, folder):
    """The total series, truncated month dropped, every month present."""
    monthly = series.monthly_series(testbed.fact(spark, folder), testbed.dates(spark, folder))
    return series.regular_grid(series.drop_truncated_month(monthly))


def _country_grid(spark, folder):
    s = testbed.star(spark, folder)
    monthly = series.series_by_country(s.fact, s.dates, s.customers)
    return series.regular_grid(series.drop_truncated_month(monthly))


@query
def history_plus_forecast(spark, folder):
    return serving.history_plus_forecast(
        trends.revenue_history(testbed.fact(spark, folder), testbed.dates(spark, folder)),
        forecasting.seasonal_naive_forecast(_grid(spark, folder)),
    )


@query
def forecast_totals(spark, folder):
    grid = cut(_country_grid(spark, folder))
    best = series.best_forecaster(series.forecast_scores(series.baseline_forecasts(grid)))
    return serving.forecast_totals(forecasting.seasonal_naive_forecast(grid), best)


# ---- segmentation -----------------------------------------------------------------------------


@query
def rfm_features(spark, folder):
    scaled = segments.rfm_features(cut(_values(spark, folder)))
    return scaled.select(
        "customer_id", *[half_up(F.col(f"{c}_z"), 6).alias(f"{c}_z") for c in segments.RFM]
    )


@query
def kmeans_sweep(spark, folder):
    return segments.kmeans_sweep(cut(_values(spark, folder)))


@query
def kmeans_best_k(spark, folder):
    return segments.best_k(segments.kmeans_sweep(cut(_values(spark, folder))))


@query
def kmeans_fit(spark, folder):
    """The centres of the chosen fit."""
    fitted = segments.kmeans_fit(cut(_values(spark, folder)))
    rows = [(i, *center) for i, center in enumerate(fitted.centers)]
    names = ", ".join(f"{c}_z double" for c in segments.RFM)
    return spark.createDataFrame(rows, f"cluster_id int, {names}")


@query
def kmeans_predict(spark, folder):
    values = cut(_values(spark, folder))
    return segments.kmeans_fit(values).predict(values)


def _profiles(spark, folder):
    clustered = cut(testbed.with_fixed_clusters(_scores(spark, folder)))
    return clustered, segments.segment_profiles(clustered)


@query
def segment_profiles(spark, folder):
    return _profiles(spark, folder)[1]


@query
def segment_names(spark, folder):
    return segments.segment_names(_profiles(spark, folder)[1])


@query
def assign_segments(spark, folder):
    """Cluster 3 has no name and falls back to its number."""
    clustered, profiles = _profiles(spark, folder)
    names = segments.segment_names(profiles).where(F.col("cluster_id") != 3)
    return segments.assign_segments(clustered, names).select(
        "customer_id", "cluster_id", "segment_name", "rfm_total"
    )


# ---- churn models -----------------------------------------------------------------------------


def _features(spark, folder):
    s = testbed.star(spark, folder)
    return features.churn_features(s.fact, s.dates, s.customers)


@query
def churn_features(spark, folder):
    s = testbed.star(spark, folder)
    table = testbed.feature_table(customers.rfm_values(s.fact, s.dates))
    return features.churn_features(s.fact, s.dates, s.customers, table)


@query
def purchase_trend(spark, folder):
    s = testbed.star(spark, folder)
    return features.purchase_trend(s.fact, s.dates, s.customers)


@query
def churn_label(spark, folder):
    """Customers on either side of two thresholds."""
    recency = F.col("recency_days")
    return _values(spark, folder).select(
        "customer_id",
        features.churn_label(recency).alias("churned_90"),
        features.churn_label(recency, Settings(churn_days=30)).alias("churned_30"),
    )


def _gappy(spark, folder):
    """Features with missing values by key."""
    key = F.col("customer_id")
    return _features(spark, folder).withColumns({
        "avg_items_per_order": F.when(key % 5 != 0, F.col("avg_items_per_order")),
        "region": F.when(key % 7 != 0, F.col("region")),
    })


@query
def impute(spark, folder):
    return features.impute(_gappy(spark, folder)).select(
        "customer_id", *NUMERIC_FEATURES, "region", "acquisition_channel", "age_group"
    )


@query
def encode_categories(spark, folder):
    coded = features.encode_categories(features.impute(_gappy(spark, folder)))
    return coded.select(
        "customer_id", "region_enc", "acquisition_channel_enc", "age_group_enc"
    )


@query
def stratified_split(spark, folder):
    return features.stratified_split(_features(spark, folder)).select(
        "customer_id", "churn_label", "is_test"
    )


@query
def scale_features(spark, folder):
    split = cut(features.stratified_split(features.impute(_features(spark, folder))))
    scaled = features.scale_features(split)
    return scaled.select(
        "customer_id", "is_test", *[half_up(F.col(c), 6).alias(c) for c in NUMERIC_FEATURES]
    )


def _trained(spark, folder, name):
    data = classifiers.prepare(_features(spark, folder))
    return data, classifiers.fit_model(name, data)


def _predictions(name):
    def run(spark, folder):
        data, model = _trained(spark, folder, name)
        return classifiers.predict(name, model, data.test)

    return run


QUERIES["fit_logistic"] = _predictions("logistic_regression")
QUERIES["fit_forest"] = _predictions("random_forest")
QUERIES["fit_boosted"] = _predictions("boosted_trees")


@query
def feature_importance(spark, folder):
    _, model = _trained(spark, folder, "random_forest")
    return classifiers.feature_importance(model, spark)


@query
def top_features(spark, folder):
    """Inputs weighted by their spread over customers, so that the ranking has an expectation."""
    complete = features.impute(_features(spark, folder))
    spread = complete.agg(*[F.countDistinct(c).alias(c) for c in NUMERIC_FEATURES])
    weights = spread.select(F.inline(F.array(*[
        F.struct(F.lit(f"{c}_enc").alias("feature"), (F.col(c) / 10000.0).alias("importance"))
        for c in NUMERIC_FEATURES
    ])))
    return serving.top_features(weights, 5)


@query
def score_all(spark, folder):
    """Every customer, with the model that ranks the test rows best."""
    customers_in = cut(_features(spark, folder))
    data = classifiers.prepare(customers_in)
    fitted = {name: classifiers.fit_model(name, data) for name in classifiers.MODELS}
    tested = [classifiers.predict(name, model, data.test) for name, model in fitted.items()]
    comparison = metrics.evaluate_models(cut(reduce(DataFrame.unionByName, tested)))
    best = metrics.best_model(comparison).first()["model"]
    return classifiers.score_all(customers_in, fitted[best], data.encoder)


def _scored(spark, folder):
    return cut(testbed.fixed_scores(_features(spark, folder)))


@query
def evaluate_models(spark, folder):
    return metrics.evaluate_models(_scored(spark, folder))


def _comparison_report(spark, folder):
    """The folder of a written comparison of models, and its schema."""
    comparison = metrics.evaluate_models(_scored(spark, folder))
    path = os.path.join(shared_folder(spark), f"models-{uuid.uuid4().hex}")
    reports.write_csv(comparison, path)
    return path, comparison.schema


@query
def report_scan(spark, folder):
    """A written report with its schema, and one that was not written yet, which has no rows."""
    path, schema = _comparison_report(spark, folder)
    absent = reports.read_report(spark, f"{path}-absent", schema)
    return reports.read_report(spark, path, schema).unionByName(absent)


@query
def model_metrics(spark, folder):
    path, schema = _comparison_report(spark, folder)
    return serving.model_metrics(reports.read_report(spark, path, schema))


@query
def threshold_sweep(spark, folder):
    return metrics.threshold_sweep(_scored(spark, folder))


@query
def risk_tiers(spark, folder):
    return _scored(spark, folder).select(
        "model",
        "customer_id",
        risk_tier(F.col("score")).alias("risk_tier"),
        risk_tier(F.col("score"), right_closed=True).alias("risk_tier_right_closed"),
    )


@query
def roc_points(spark, folder):
    return metrics.roc_points(_scored(spark, folder))


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_scored(spark, folder))


# ---- time series ------------------------------------------------------------------------------


@query
def monthly_series(spark, folder):
    s = testbed.star(spark, folder)
    return series.series_by_country(s.fact, s.dates, s.customers).unionByName(
        series.monthly_series(s.fact, s.dates)
    )


@query
def drop_truncated_month(spark, folder):
    s = testbed.star(spark, folder)
    return series.drop_truncated_month(
        series.series_by_country(s.fact, s.dates, s.customers)
    )


@query
def regular_grid(spark, folder):
    """Country series with two months of every third year taken out."""
    s = testbed.star(spark, folder)
    monthly = series.series_by_country(s.fact, s.dates, s.customers)
    taken = (F.year("month") % 3 == 0) & F.month("month").isin(4, 5)
    return series.regular_grid(monthly.where(~taken))


@query
def decompose(spark, folder):
    parts = series.decompose(_country_grid(spark, folder))
    return parts.select(
        "series_key",
        "month",
        *[half_up(F.col(c)).alias(c) for c in ("observed", "trend", "seasonal", "residual")],
    )


@query
def anomalies(spark, folder):
    found = series.anomalies(series.decompose(_country_grid(spark, folder)))
    return found.select("series_key", "month", "value", "is_anomaly", "anomaly_type")


@query
def walk_forward_folds(spark, folder):
    return series.walk_forward_folds(
        _country_grid(spark, folder).select("series_key", "month", "value")
    )


@query
def forecast_scores(spark, folder):
    return series.forecast_scores(series.baseline_forecasts(_country_grid(spark, folder)))


@query
def best_forecaster(spark, folder):
    scores = series.forecast_scores(series.baseline_forecasts(_country_grid(spark, folder)))
    return series.best_forecaster(scores)


def _walk(model):
    def run(spark, folder):
        grid = cut(_country_grid(spark, folder))
        return forecasting.walk_forward(grid, (model,))

    return run


QUERIES["arima_111"] = _walk(forecasting.ARIMA)
QUERIES["sarima"] = _walk(forecasting.SARIMA)
QUERIES["trend_seasonal"] = _walk(forecasting.TREND)


@query
def forecast(spark, folder):
    """Next months of every country by its best model over the folds."""
    grid = cut(_country_grid(spark, folder))
    scores = series.forecast_scores(forecasting.walk_forward(grid))
    return forecasting.forecast(grid, series.best_forecaster(scores))


@query
def seasonal_naive_forecast(spark, folder):
    found = forecasting.seasonal_naive_forecast(_country_grid(spark, folder))
    return found.select(
        "series_key",
        "date",
        *[half_up(F.col(c)).alias(c) for c in ("forecast", "lower_bound", "upper_bound")],
    )
