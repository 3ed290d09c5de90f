"""Fitted operators over planted truth: all customers and series of the tables, with labels, groups or values put
in so that SQL can tell what a right fit must find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import testbed
from checks.oracles import ORACLES, RAW, RFM, _KEY, _WELCH, CHURN, SERIES, hash32, modelled, rounded, star
from checks.queries import _churn_metrics, _country_grid, _features, _values, query
from tillpath.fixed_values import NON_PRODUCT_CODES
from tillpath.functions.numeric import half_up
from tillpath.operators import classifiers, cleaning, features, forecasting, metrics, segments, series, welch
from tillpath.session import cut
from tillpath.sources import feeds

# ---- classifiers: one feature separates the planted label -------------------------------------


def _labelled(spark, folder) -> DataFrame:
    """All customers; two of five are planted as churned and have 100 orders more than any other."""
    key = testbed.key_hash("customer_id")
    churned = key % 5 < 2
    planted = _features(spark, folder).withColumn("churn_label", churned)
    orders = F.when(churned, 100).otherwise(0) + key % 10
    return cut(planted.withColumn("frequency", orders.cast(planted.schema["frequency"].dataType)))


def _found(name: str):
    def run(spark, folder):
        """Label that the model gives to every customer, and its most important input."""
        rows = _labelled(spark, folder)
        data = classifiers.prepare(rows)
        model = classifiers.fit_model(name, data)
        first = classifiers.feature_importance(model, spark).first()["feature"]
        return classifiers.predict(name, model, data.rows).select(
            "customer_id", F.col("label").cast("int").alias("label"), (F.col("score") >= 0.5).alias("predicted"),
            F.lit(first).alias("top_feature"),
        )

    run.__name__ = f"planted_{name}"
    return run


for _name in classifiers.MODELS:
    query(_found(_name))
    ORACLES[f"planted_{_name}"] = modelled(
        f"SELECT customer_id, CAST({_KEY} % 5 < 2 AS INTEGER) AS label, {_KEY} % 5 < 2 AS predicted, "
        "'frequency' AS top_feature FROM model_customers"
    )


@query
def planted_importance(spark, folder):
    """Which of all inputs carry weight in the forest: the planted one first, and its rank alone."""
    model = classifiers.fit_model("random_forest", classifiers.prepare(_labelled(spark, folder)))
    found = classifiers.feature_importance(model, spark)
    return found.agg(
        F.count(F.lit(1)).alias("inputs"), F.max_by("feature", "importance").alias("top_feature"),
        half_up(F.sum("importance"), 6).alias("total"),
        (F.max("importance") > 0.5).alias("more_than_half"),
    )


ORACLES["planted_importance"] = (
    f"SELECT CAST({len(classifiers.INPUTS)} AS BIGINT) AS inputs, 'frequency' AS top_feature, 1e0 AS total, true AS more_than_half"
)


@query
def planted_score_all(spark, folder):
    """Every customer scored by the best of the three models on the test rows."""
    rows = _labelled(spark, folder)
    data = classifiers.prepare(rows)
    fitted = {name: classifiers.fit_model(name, data) for name in classifiers.MODELS}
    tested = [classifiers.predict(name, model, data.test) for name, model in fitted.items()]
    best = metrics.best_model(metrics.evaluate_models(cut(reduce(DataFrame.unionByName, tested)))).first()["model"]
    return classifiers.score_all(rows, fitted[best], data.encoder).select(
        "customer_id", "churn_observed", "churn_predicted", "risk_tier"
    )


ORACLES["planted_score_all"] = modelled(
    f"SELECT customer_id, {_KEY} % 5 < 2 AS churn_observed, {_KEY} % 5 < 2 AS churn_predicted, "
    f"CASE WHEN {_KEY} % 5 < 2 THEN 'high' ELSE 'low' END AS risk_tier FROM model_customers"
)

# ---- clusters: four groups far apart ----------------------------------------------------------

# Days, orders and money of the planted groups; a customer adds a little by number.
_CENTRES = [(2, 400, 900000), (3, 300, 20), (800, 3, 500000), (900, 2, 10)]


def _grouped(spark, folder) -> DataFrame:
    """All customers in four groups by hash."""
    group, little = testbed.key_hash("customer_id") % 4, F.col("customer_id") % 3

    def pick(place: int):
        value = F.lit(_CENTRES[3][place])
        for g in (2, 1, 0):
            value = F.when(group == g, _CENTRES[g][place]).otherwise(value)
        return value + little

    return cut(_values(spark, folder).select(
        "customer_id", pick(0).cast("int").alias("recency_days"), pick(1).cast("long").alias("frequency"),
        pick(2).cast("decimal(22,2)").alias("monetary"),
    ))


def _case(place: int) -> str:
    cases = " ".join(f"WHEN {g} THEN {c[place]}" for g, c in enumerate(_CENTRES))
    return f"CASE {_KEY} % 4 {cases} END + customer_id % 3"


_GROUPS = f"""
planted AS (
  SELECT customer_id, {_KEY} % 4 AS g, {_case(0)} AS recency_days, {_case(1)} AS frequency, {_case(2)} AS monetary
  FROM rfm)"""


@query
def planted_clusters(spark, folder):
    """Every customer with the first customer of the cluster it is put in."""
    values = _grouped(spark, folder)
    clustered = cut(segments.kmeans_fit(values).predict(values).select("customer_id", "cluster_id"))
    first = clustered.groupBy("cluster_id").agg(F.min("customer_id").alias("first_customer"))
    return clustered.join(F.broadcast(first), "cluster_id").select("customer_id", "first_customer")


ORACLES["planted_clusters"] = star(
    "SELECT customer_id, min(customer_id) OVER (PARTITION BY g) AS first_customer FROM planted", RFM, _GROUPS
)


@query
def planted_centres(spark, folder):
    """The centres of the fit."""
    fitted = segments.kmeans_fit(_grouped(spark, folder))
    names = [f"{c}_z" for c in segments.RFM]
    rows = spark.createDataFrame(fitted.centers, ", ".join(f"{c} double" for c in names))
    return rows.select(*[half_up(F.col(c), 6).alias(c) for c in names])


_LOGS = ", ".join(
    f"(ln(1 + {c}) - avg(ln(1 + {c})) OVER ()) / stddev_pop(ln(1 + {c})) OVER () AS {c}_z" for c in segments.RFM
)
ORACLES["planted_centres"] = star(
    "SELECT " + ", ".join(f"{rounded(f'avg({c}_z)', 6)} AS {c}_z" for c in segments.RFM)
    + f" FROM (SELECT g, {_LOGS} FROM planted) GROUP BY g", RFM, _GROUPS
)


@query
def planted_best_k(spark, folder):
    """The sweep over the number of clusters, and which of them is chosen."""
    sweep = cut(segments.kmeans_sweep(_grouped(spark, folder)))
    chosen = segments.best_k(sweep).select(F.col("best_k"))
    return sweep.crossJoin(F.broadcast(chosen)).select("k", (F.col("k") == F.col("best_k")).alias("chosen"))


ORACLES["planted_best_k"] = star(
    "SELECT CAST(k AS INTEGER) AS k, k = (SELECT count(DISTINCT g) FROM planted) AS chosen "
    "FROM (SELECT unnest(generate_series(2, 10)) AS k)", RFM, _GROUPS
)

# ---- forecasts: constant, short and broken series next to all real ones ------------------------


def _with_planted(spark, folder) -> DataFrame:
    """The series of all countries, and for each of them a constant one (its number of months times ten), one of three
    months and one without its tenth month."""
    real = cut(_country_grid(spark, folder).select("series_key", "month", F.col("value").cast("double").alias("value")))
    sizes = real.groupBy("series_key").agg(F.count(F.lit(1)).alias("n"), F.min("month").alias("first"))
    placed = real.join(F.broadcast(sizes), "series_key").withColumn(
        "at", F.months_between("month", "first").cast("int")
    )

    def kind(name: str, value) -> DataFrame:
        return placed.select(F.concat(F.lit(f"{name}:"), "series_key").alias("series_key"), "month", value.alias("value"), "at")

    constant = (F.col("n") * 10).cast("double")
    made = [
        kind("constant", constant).drop("at"),
        kind("short", constant).where("at < 3").drop("at"),
        kind("broken", F.when(F.col("at") != 9, constant)).drop("at"),
    ]
    return cut(reduce(DataFrame.unionByName, [real, *made]))


_PLANTED = """
sized AS (
  SELECT series_key, month, CAST(exact AS DOUBLE) AS value,
         CAST(count(*) OVER (PARTITION BY series_key) * 10 AS DOUBLE) AS constant,
         row_number() OVER (PARTITION BY series_key ORDER BY month) - 1 AS pos
  FROM grid WHERE series_key <> 'all'),
planted AS (
  SELECT series_key, month, value FROM sized
  UNION ALL SELECT 'constant:' || series_key, month, constant FROM sized
  UNION ALL SELECT 'short:' || series_key, month, constant FROM sized WHERE pos < 3
  UNION ALL SELECT 'broken:' || series_key, month, CASE WHEN pos <> 9 THEN constant END FROM sized),
steps AS (
  SELECT series_key, month, value, row_number() OVER o - 1 AS pos,
         count(*) OVER (PARTITION BY series_key) AS n,
         count(*) FILTER (value IS NULL) OVER (PARTITION BY series_key ORDER BY month
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gaps
  FROM planted WINDOW o AS (PARTITION BY series_key ORDER BY month))"""
_SHORTEST = {forecasting.ARIMA: 5, forecasting.SARIMA: 15, forecasting.TREND: 4}
def _is_constant():
    return F.col("series_key").startswith("constant:")



def _walked(name: str, model: str):
    def run(spark, folder):
        """One-step predictions over the folds: those of the constant series by value, all others by what went wrong."""
        found = forecasting.walk_forward(_with_planted(spark, folder), (model,))
        return found.select(
            "series_key", "model", "fold", "month", "actual", "error",
            F.when(_is_constant(), half_up(F.col("predicted"))).alias("constant"),
            F.col("predicted").isNotNull().alias("has_prediction"),
        )

    run.__name__ = name
    return run


for _name, _model in (
    ("planted_arima", forecasting.ARIMA), ("planted_sarima", forecasting.SARIMA), ("planted_trend", forecasting.TREND)
):
    query(_walked(_name, _model))
    _error = f"""CASE WHEN gaps > 0 THEN 'series has a gap'
      WHEN pos < {_SHORTEST[_model]} THEN CAST(pos AS VARCHAR) || ' months are too few' END"""
    ORACLES[_name] = star(f"""
SELECT series_key, '{_model}' AS model, CAST(fold AS INTEGER) AS fold, month, value AS actual, {_error} AS error,
       CASE WHEN series_key LIKE 'constant:%' THEN value END AS constant, ({_error}) IS NULL AS has_prediction
FROM steps, (SELECT unnest(generate_series(0, 5)) AS fold) WHERE pos = n - 6 + fold AND pos > 0""", SERIES, _PLANTED)


def _model_of(key):
    """Models in turn, by the length of the key."""
    models = F.array(*[F.lit(m) for m in forecasting.MODELS])
    return F.element_at(models, (F.length(key) % 3 + 1).cast("int"))


@query
def planted_forecast(spark, folder):
    """The coming months of all series, each by the model it is given; the bounds of a constant series lie on it."""
    rows = _with_planted(spark, folder)
    best = rows.select("series_key").distinct().select("series_key", _model_of(F.col("series_key")).alias("model"))
    found = forecasting.forecast(rows, best)
    return found.select(
        "series_key", "model", "date", "error",
        *[F.when(_is_constant(), half_up(F.col(c))).alias(c) for c in ("forecast", "lower_bound", "upper_bound")],
    )


_MODEL = "(" + repr(list(forecasting.MODELS)) + ")[length(series_key) % 3 + 1]"
_LEAST = "(" + repr([_SHORTEST[m] for m in forecasting.MODELS]) + ")[length(series_key) % 3 + 1]"
_CONSTANT = "CASE WHEN series_key LIKE 'constant:%' THEN value END"
ORACLES["planted_forecast"] = star(f"""
SELECT series_key, {_MODEL} AS model, CASE WHEN error IS NULL THEN CAST(last + to_months(CAST(ahead AS INTEGER)) AS DATE) END AS date,
       error, CASE WHEN error IS NULL THEN {_CONSTANT} END AS forecast,
       CASE WHEN error IS NULL THEN {_CONSTANT} END AS lower_bound, CASE WHEN error IS NULL THEN {_CONSTANT} END AS upper_bound
FROM (SELECT series_key, max(month) AS last, max(value) AS value,
             CASE WHEN count_if(value IS NULL) > 0 THEN 'series has a gap'
                  WHEN count(*) < {_LEAST} THEN CAST(count(*) AS VARCHAR) || ' months are too few' END AS error
      FROM planted GROUP BY 1), (SELECT unnest(generate_series(1, 6)) AS ahead)
WHERE error IS NULL OR ahead = 1""", SERIES, _PLANTED)

# ---- Welch's test -----------------------------------------------------------------------------


@query
def welch_p_values(spark, folder):
    """p to six digits, and the wording."""
    return welch.welch_tests(_churn_metrics(spark, folder)).select(
        "metric", half_up(F.col("p_value"), 6).alias("p_value"), "significant", "interpretation"
    )


# The density over the angle atan(t / sqrt(df)) is a power of the cosine: Simpson's rule on both parts of the range.
ORACLES["welch_p_values"] = star(f"""
SELECT metric, {rounded('p', 6)} AS p_value, p < 0.05 AS significant,
       'Retained customers have ' || CASE WHEN ra > ca THEN 'higher' ELSE 'lower' END || ' ' || metric || ' (p='
         || CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.4f', p) END || ')' AS interpretation
FROM (SELECT metric, ra, ca, sum(w * pow(cos(low + (pi() / 2 - low) * i / 2e5), df - 1)) * (pi() / 2 - low)
               / (sum(w * pow(cos(pi() / 2 * i / 2e5), df - 1)) * pi() / 2) AS p
      FROM (SELECT *, atan(abs(t) / sqrt(df)) AS low
            FROM (SELECT *, (ra - ca) / sqrt(rv + cv) AS t,
                         (rv + cv) * (rv + cv) / (rv * rv / (rn - 1) + cv * cv / (cn - 1)) AS df FROM welch)),
           (SELECT i, CASE WHEN i = 0 OR i = 200000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
            FROM (SELECT unnest(generate_series(0, 199999)) AS i))
      GROUP BY metric, ra, ca, low)""", CHURN, _WELCH)

# ---- cleaning: white space of any kind, missing values, times of day ---------------------------


def _odd_feed(spark, folder) -> DataFrame:
    """The whole feed with tabs, no-break and wide spaces, the text `nan`, and NULLs by key, and with times of day."""
    raw = feeds.union_parts(testbed.raw_parts(spark, folder))
    part, order = F.col("StockCode").try_cast("int"), F.regexp_replace("Invoice", "C", "").cast("int")
    edges = F.when(part % 4 == 0, F.concat(F.lit("\t"), "Description", F.lit(" "))).when(
        part % 4 == 1, F.concat(F.lit(" \x1f"), "Description", F.lit("　 "))
    ).when(part % 4 == 2, "\n nan ")
    hours = F.make_dt_interval(F.lit(0), F.abs("Quantity") % 24, order % 60)
    return raw.select(
        F.when(order % 17 != 0, F.col("Invoice")).alias("Invoice"),
        F.when(order % 19 != 0, F.col("StockCode")).alias("StockCode"),
        F.coalesce(edges, F.col("Description")).alias("Description"),
        F.when(order % 29 != 0, F.col("Quantity")).alias("Quantity"),
        (F.col("InvoiceDate") + hours).alias("InvoiceDate"),
        F.when(order % 23 != 0, F.col("Price")).alias("Price"),
        "Customer ID", "Country",
    )


@query
def clean_odd_lines(spark, folder):
    """The steps up to zero quantities over the odd feed."""
    lines = cleaning.flag_returns(cleaning.drop_duplicates(cleaning.strip_strings(cleaning.rename_columns(_odd_feed(spark, folder)))))
    kept = cleaning.drop_zero_quantity(cleaning.drop_bad_prices(cleaning.drop_non_products(lines)))
    return kept.withColumn("invoice_date", F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss"))


_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _stripped(column: str) -> str:
    return f"nullif(regexp_replace(regexp_replace({column}, '^{_SPACE}', ''), '{_SPACE}$', ''), 'nan')"


ORACLES["clean_odd_lines"] = f"""WITH {RAW},
numbered AS (SELECT *, TRY_CAST(stock_code AS INTEGER) AS part, CAST(replace(invoice, 'C', '') AS INTEGER) AS o FROM renamed),
odd AS (
  SELECT CASE WHEN o % 17 <> 0 THEN invoice END AS invoice, CASE WHEN o % 19 <> 0 THEN stock_code END AS stock_code,
         CASE part % 4 WHEN 0 THEN chr(9) || description || chr(160)
              WHEN 1 THEN chr(8195) || chr(31) || description || chr(12288) || ' '
              WHEN 2 THEN chr(10) || ' nan' || chr(8232) ELSE description END AS description,
         CASE WHEN o % 29 <> 0 THEN quantity END AS quantity,
         strftime(CAST(invoice_date AS TIMESTAMP) + to_hours(abs(quantity) % 24) + to_minutes(o % 60), '%Y-%m-%d %H:%M:%S') AS invoice_date,
         CASE WHEN o % 23 <> 0 THEN price END AS price, customer_id, country FROM numbered),
plain AS (
  SELECT DISTINCT * REPLACE ({_stripped('invoice')} AS invoice, {_stripped('stock_code')} AS stock_code,
                    {_stripped('description')} AS description, {_stripped('country')} AS country) FROM odd),
marked AS (SELECT *, coalesce(invoice LIKE 'C%', false) AS is_return FROM plain)
SELECT * FROM marked
WHERE NOT coalesce(stock_code IN ({', '.join(repr(c) for c in NON_PRODUCT_CODES)})
                   OR (length(stock_code) = 1 AND regexp_matches(stock_code, '^[A-Za-z]$')), false)
  AND NOT coalesce(price <= 0.001e0 AND NOT is_return, false) AND NOT coalesce(quantity = 0, false)"""
