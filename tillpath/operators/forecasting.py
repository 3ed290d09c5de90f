"""Forecast models, fitted per series in parallel.

Spark groups the rows by series (and fold) and calls a small numpy fit per group. A group is one
series of months, so it is bounded by the calendar however many lines the series came from. A series
a model cannot handle yields a row with `error` instead of failing the job.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpath.config import DEFAULTS, Settings
from tillpath.operators.series import walk_forward_folds

# Executors get these functions with the task, not from an installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARIMA, SARIMA, TREND = "ARIMA(1,1,1)", "SARIMA", "TrendSeasonal"
MODELS = (ARIMA, SARIMA, TREND)
_Z95 = 1.959963984540054
_SEASON = 12


@dataclass(frozen=True)
class Forecast:
    mean: np.ndarray
    deviation: np.ndarray


def _lagged(rows: np.ndarray, t: int, lag: int) -> np.ndarray | float:
    return rows[..., t - lag] if t >= lag else 0.0


def _residuals(w: np.ndarray, params: np.ndarray) -> np.ndarray:
    """One-step errors of the (seasonal) ARMA recursion for many parameter rows at once.

    `params` has columns ar, ma, seasonal ar, seasonal ma; what lies before the data counts as 0.
    """
    ar, ma, sar, sma = params.T
    errors = np.zeros((len(params), len(w)))
    for t in range(len(w)):
        guess = ar * _lagged(w, t, 1) + sar * _lagged(w, t, _SEASON)
        guess = guess - ar * sar * _lagged(w, t, _SEASON + 1)
        guess = guess + ma * _lagged(errors, t, 1) + sma * _lagged(errors, t, _SEASON)
        guess = guess + ma * sma * _lagged(errors, t, _SEASON + 1)
        errors[:, t] = w[t] - guess
    return errors


def _fit_arma(w: np.ndarray, seasonal: bool) -> np.ndarray:
    """Least-squares parameters: a grid over the stationary range, then ever finer grids."""
    active = 4 if seasonal else 2
    skip = (_SEASON + 1) if seasonal and len(w) > 2 * _SEASON else 1
    points = 7 if seasonal else 21
    best, width = np.zeros(active), 0.98
    for _ in range(9):
        axes = [
            np.unique(np.clip(np.linspace(b - width, b + width, points), -0.98, 0.98)) for b in best
        ]
        grid = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, active)
        params = np.zeros((len(grid), 4))
        params[:, :active] = grid
        cost = (_residuals(w, params)[:, skip:] ** 2).sum(axis=1)
        best = grid[int(np.argmin(cost))]
        width *= 0.4
    full = np.zeros(4)
    full[:active] = best
    return full


def _arma_forecast(y: np.ndarray, steps: int, seasonal: bool) -> Forecast:
    """Difference once, fit, run the recursion on with zero errors, and sum up again."""
    w = np.diff(y)
    params = _fit_arma(w, seasonal)
    errors = _residuals(w, params[None, :])[0]
    used = errors[1:] if len(errors) > 1 else errors
    variance = float((used**2).sum() / max(len(used) - (4 if seasonal else 2), 1))
    ar, ma, sar, sma = params

    def extend(history: np.ndarray, noise: np.ndarray) -> np.ndarray:
        w_all = np.concatenate([history, np.zeros(steps)])
        e_all = np.concatenate([noise, np.zeros(steps)])
        for t in range(len(history), len(w_all)):
            w_all[t] = (
                ar * _lagged(w_all, t, 1) + sar * _lagged(w_all, t, _SEASON)
                - ar * sar * _lagged(w_all, t, _SEASON + 1)
                + ma * _lagged(e_all, t, 1) + sma * _lagged(e_all, t, _SEASON)
                + ma * sma * _lagged(e_all, t, _SEASON + 1)
            )
        return w_all[len(history):]

    mean = y[-1] + np.cumsum(extend(w, errors))
    # Effect of one unit of noise on the differences, then on the level, over the horizon.
    impulse = np.concatenate([[1.0], extend(np.array([1.0]), np.array([1.0]))])[:steps]
    effect = np.cumsum(impulse)
    return Forecast(mean, np.sqrt(variance * np.cumsum(effect**2)))


def _trend_forecast(y: np.ndarray, month_of_year: np.ndarray, steps: int) -> Forecast:
    """Line plus yearly Fourier terms, the latter with a light ridge penalty."""
    n = len(y)
    at = np.arange(n + steps, dtype=float)
    phase = (month_of_year[0] - 1 + np.arange(n + steps)) % _SEASON
    terms = [np.ones(n + steps), at / max(n - 1, 1)]
    for k in range(1, 6):
        terms += [np.sin(2 * np.pi * k * phase / _SEASON), np.cos(2 * np.pi * k * phase / _SEASON)]
    x = np.stack(terms, axis=1)
    penalty = np.diag([1e-9, 1e-9] + [0.1] * (x.shape[1] - 2))
    inverse = np.linalg.inv(x[:n].T @ x[:n] + penalty)
    weights = inverse @ x[:n].T @ y
    residual = y - x[:n] @ weights
    freedom = max(n - float(np.trace(x[:n] @ inverse @ x[:n].T)), 1.0)
    variance = float((residual**2).sum() / freedom)
    ahead = x[n:]
    spread = 1.0 + np.einsum("ij,jk,ik->i", ahead, inverse, ahead)
    return Forecast(ahead @ weights, np.sqrt(variance * spread))


_SHORTEST = {ARIMA: 5, SARIMA: 15, TREND: 4}


def fit_and_forecast(model: str, months: pd.Series, values: np.ndarray, steps: int) -> Forecast:
    """Forecast `steps` months after the last one; raises ValueError where that is not possible."""
    y = np.asarray(values, dtype=float)
    if np.isnan(y).any():
        raise ValueError("series has a gap")
    if model not in _SHORTEST:
        raise ValueError(f"unknown model {model}")
    if len(y) < _SHORTEST[model]:
        raise ValueError(f"{len(y)} months are too few")
    if model == TREND:
        return _trend_forecast(y, pd.to_datetime(months).dt.month.to_numpy(), steps)
    # Scaling keeps the sums of squares in a safe range; the model is linear, so it cancels out.
    unit = float(np.abs(y).max()) or 1.0
    scaled = _arma_forecast(y / unit, steps, seasonal=model == SARIMA)
    return Forecast(scaled.mean * unit, scaled.deviation * unit)


_FOLD_SCHEMA = (
    "series_key string, model string, fold int, month date, actual double, predicted double, "
    "error string"
)


def _predict_fold(models: tuple[str, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def predict(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("month")
        train, test = rows[~rows["is_test"]], rows[rows["is_test"]]
        out = []
        for model in models:
            predicted, error = None, None
            try:
                found = fit_and_forecast(model, train["month"], train["value"].to_numpy(), 1)
                predicted = float(found.mean[0])
            except (ValueError, np.linalg.LinAlgError) as problem:
                error = str(problem)
            for row in test.itertuples():
                out.append((row.series_key, model, row.fold, row.month, row.value, predicted, error))
        return pd.DataFrame(
            out,
            columns=["series_key", "model", "fold", "month", "actual", "predicted", "error"],
        )

    return predict


def walk_forward(
    series: DataFrame, models: tuple[str, ...] = MODELS, folds: int = DEFAULTS.folds
) -> DataFrame:
    """One-step predictions of every model over expanding folds, one group per series and fold."""
    rows = walk_forward_folds(
        series.select("series_key", "month", F.col("value").cast("double").alias("value")), folds
    )
    return rows.groupBy("series_key", "fold").applyInPandas(_predict_fold(models), _FOLD_SCHEMA)


_FORECAST_SCHEMA = (
    "series_key string, model string, date date, forecast double, lower_bound double, "
    "upper_bound double, error string"
)


def _predict_future(steps: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    columns = [
        "series_key", "model", "date", "forecast", "lower_bound", "upper_bound", "error",
    ]

    def predict(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("month")
        key, model = rows["series_key"].iloc[0], rows["model"].iloc[0]
        start = pd.Timestamp(rows["month"].iloc[-1])
        dates = [(start + pd.DateOffset(months=i + 1)).date() for i in range(steps)]
        try:
            found = fit_and_forecast(model, rows["month"], rows["value"].to_numpy(), steps)
        except (ValueError, np.linalg.LinAlgError) as problem:
            return pd.DataFrame([(key, model, None, None, None, None, str(problem))], columns=columns)
        reach = _Z95 * found.deviation
        return pd.DataFrame({
            "series_key": key,
            "model": model,
            "date": dates,
            "forecast": found.mean,
            "lower_bound": found.mean - reach,
            "upper_bound": found.mean + reach,
            "error": None,
        })

    return predict


def forecast(
    series: DataFrame,
    best: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    *,
    periods: int | None = None,
) -> DataFrame:
    """The next months with 95 % bounds by the best model of each series, SARIMA where none is set."""
    rows = series.select("series_key", "month", F.col("value").cast("double").alias("value"))
    if best is None:
        chosen = rows.withColumn("model", F.lit(SARIMA))
    else:
        chosen = rows.join(best.select("series_key", "model"), "series_key", "left").na.fill(
            {"model": SARIMA}
        )
    return chosen.groupBy("series_key").applyInPandas(
        _predict_future(periods or settings.horizon), _FORECAST_SCHEMA
    )


def seasonal_naive_forecast(series: DataFrame, periods: int = DEFAULTS.horizon) -> DataFrame:
    """Each coming month as the same month a year before; bounds by the spread of yearly changes.

    A rule without a fit, as a reference line for the models. Up to twelve months ahead.
    """
    if not 1 <= periods <= _SEASON:
        raise ValueError("between 1 and 12 months")
    value = F.col("value").cast("double")
    ordered = Window.partitionBy("series_key").orderBy("month")
    change = value - F.lag(value, _SEASON).over(ordered)
    whole = series.withColumn("_change", change).groupBy("series_key").agg(
        F.max("month").alias("last_month"),
        F.sqrt(F.avg(F.col("_change") * F.col("_change"))).alias("spread"),
    )
    ahead = F.months_between(F.add_months("month", _SEASON), F.col("last_month")).cast("int")
    return (
        series.join(whole, "series_key")
        .where(ahead.between(1, periods))
        .select(
            "series_key",
            F.lit("seasonal_naive").alias("model"),
            F.add_months("month", _SEASON).alias("date"),
            value.alias("forecast"),
            (value - _Z95 * F.col("spread")).alias("lower_bound"),
            (value + _Z95 * F.col("spread")).alias("upper_bound"),
        )
    )
