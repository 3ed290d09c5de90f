from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import day, rows
from tillpath.operators import forecasting, series, serving


def month(i: int) -> dt.date:
    return dt.date(2018 + i // 12, i % 12 + 1, 1)


def arrange(spark, named):
    data = [(k, month(i), float(v)) for k, values in named.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame(data, "series_key string, month date, value double")
    return frame.withColumn("value", F.col("value").cast("decimal(22,2)"))


def wave(n, slope=0.0, height=100.0, level=1000.0):
    return [level + slope * i + height * np.sin(2 * np.pi * (i % 12) / 12) for i in range(n)]


def test_truncated_month_is_judged_by_the_others(spark):
    df = arrange(spark, {"cut": [100, 100, 49], "kept": [100, 100, 50], "single": [5]})
    got = series.drop_truncated_month(df)
    assert rows(got.groupBy("series_key").count()) == [("cut", 2), ("kept", 3), ("single", 1)]


def test_grid_marks_gaps(spark):
    df = arrange(spark, {"a": [1, 2, 3, 4]}).where("month <> '2018-02-01'")
    got = series.regular_grid(df).orderBy("month").collect()
    assert [r["is_gap"] for r in got] == [False, True, False, False]
    assert got[1]["value"] is None


def test_decomposition_of_line_plus_wave(spark):
    df = arrange(spark, {"a": wave(36, slope=3.0), "short": wave(23)})
    got = series.decompose(df).orderBy("month").collect()
    assert {r["series_key"] for r in got} == {"a"} and len(got) == 36
    middle = got[6:-6]
    assert all(r["trend"] is None for r in got[:6] + got[-6:])
    assert all(abs(r["trend"] - (1000 + 3 * (i + 6))) < 0.01 for i, r in enumerate(middle))
    assert all(abs(r["observed"] - r["trend"] - r["seasonal"] - r["residual"]) < 1e-9 for r in middle)
    assert abs(sum(r["seasonal"] for r in got[:12])) < 1e-6
    assert max(abs(r["residual"]) for r in middle) < 0.1


def test_a_gap_leaves_no_trend_around_it(spark):
    df = series.regular_grid(arrange(spark, {"a": wave(40)}).where("month <> '2019-07-01'"))
    got = {r["month"]: r["trend"] for r in series.decompose(df).collect()}
    assert got[day("2019-07-01")] is None and got[day("2019-02-01")] is None
    assert got[day("2018-07-01")] is not None


def test_spike_is_found(spark):
    values = [v + (i * 37 % 11) for i, v in enumerate(wave(48))]
    values[20] += 900
    got = series.anomalies(series.decompose(arrange(spark, {"a": values})))
    found = {r["month"]: r["anomaly_type"] for r in got.where("is_anomaly").collect()}
    assert found[month(20)] == "spike"
    assert got.where("residual IS NULL AND anomaly_type <> 'normal'").count() == 0


def test_folds_never_see_the_future(spark):
    df = arrange(spark, {"a": range(1, 11)})
    got = series.walk_forward_folds(df, 3)
    for fold in range(3):
        part = got.where(f"fold = {fold}")
        test = part.where("is_test").collect()
        assert [r["month"] for r in test] == [month(7 + fold)]
        assert part.where("NOT is_test").agg(F.max("month")).first()[0] == month(6 + fold)


def test_baselines_and_scores_by_hand(spark):
    df = arrange(spark, {"a": [10, 20, 40]})
    predictions = series.baseline_forecasts(df, 1)
    assert rows(predictions.select("model", "actual", "predicted")) == [
        ("drift", 40.0, 30.0), ("naive", 40.0, 20.0),
    ]
    scores = series.forecast_scores(predictions)
    assert [tuple(r) for r in scores.collect()] == [
        ("a", "drift", 25.0, 10.0, 1), ("a", "naive", 50.0, 20.0, 1),
    ]
    assert rows(series.best_forecaster(scores)) == [("a", "drift", 25.0)]


def test_a_model_that_failed_on_a_fold_is_not_chosen(spark):
    df = spark.createDataFrame(
        [("a", "patchy", 0, 10.0, 10.0), ("a", "patchy", 1, 10.0, None),
         ("a", "whole", 0, 10.0, 11.0), ("a", "whole", 1, 10.0, 9.0)],
        "series_key string, model string, fold int, actual double, predicted double",
    )
    scores = series.forecast_scores(df)
    assert {r["model"]: (r["mape"], r["folds_scored"]) for r in scores.collect()} == {
        "patchy": (0.0, 1), "whole": (10.0, 2),
    }
    assert rows(series.best_forecaster(scores)) == [("a", "whole", 10.0)]


def test_arima_recovers_an_ar_process():
    rng = np.random.default_rng(3)
    w = np.zeros(400)
    for t in range(1, 400):
        w[t] = 0.6 * w[t - 1] + rng.normal()
    params = forecasting._fit_arma(w, seasonal=False)
    assert params[0] == pytest.approx(0.6, abs=0.12) and abs(params[1]) < 0.15


@pytest.mark.parametrize("model", forecasting.MODELS)
def test_forecast_of_plain_series(model):
    months = pd.Series([month(i) for i in range(60)])
    flat = forecasting.fit_and_forecast(model, months, np.full(60, 500.0), 6)
    assert flat.mean == pytest.approx(np.full(6, 500.0), rel=1e-6)
    line = forecasting.fit_and_forecast(model, months, np.arange(60) * 10.0 + 100, 3)
    assert line.mean == pytest.approx([700, 710, 720], rel=0.05)
    assert np.all(np.diff(flat.deviation) >= -1e-9) or model == forecasting.TREND


def test_seasonal_models_follow_the_wave():
    months, values = pd.Series([month(i) for i in range(72)]), np.array(wave(72, slope=2.0))
    truth = np.array(wave(78, slope=2.0))[72:]
    for model in (forecasting.SARIMA, forecasting.TREND):
        found = forecasting.fit_and_forecast(model, months, values, 6)
        assert np.abs(found.mean - truth).max() < 40


def test_short_series_and_gaps_give_error_rows(spark):
    df = series.regular_grid(
        arrange(spark, {"ok": wave(40), "short": [1, 2, 3], "gap": wave(40)})
        .where("series_key <> 'gap' OR month <> '2019-07-01'")
    )
    walked = forecasting.walk_forward(df, folds=2)
    errors = {(r["series_key"], r["model"]): r["error"] for r in walked.collect()}
    assert errors[("ok", "SARIMA")] is None
    assert "too few" in errors[("short", "ARIMA(1,1,1)")] and "gap" in errors[("gap", "TrendSeasonal")]
    best = series.best_forecaster(series.forecast_scores(walked))
    assert {r["series_key"] for r in best.collect()} == {"ok"}
    future = forecasting.forecast(df, best, periods=6)
    good = future.where("error IS NULL").orderBy("date").collect()
    assert [r["date"] for r in good] == [month(40 + i) for i in range(6)]
    assert all(r["lower_bound"] <= r["forecast"] <= r["upper_bound"] for r in good)
    assert {r["series_key"] for r in future.where("error IS NOT NULL").collect()} == {"short", "gap"}


def test_history_meets_forecast(spark):
    history = spark.createDataFrame([("2020-01", 10.0), ("2020-02", 20.0), ("2020-03", 2.0)], "date string, revenue double")
    forecast = spark.createDataFrame([(day("2020-03-01"), 21.0, 20.0, 22.0)], "date date, forecast double, lower_bound double, upper_bound double")
    assert rows(serving.history_plus_forecast(history, forecast)) == [
        ("2020-01", 10.0, None, None, None),
        ("2020-02", 20.0, 20.0, 20.0, 20.0),
        ("2020-03", None, 21.0, 20.0, 22.0),
    ]
