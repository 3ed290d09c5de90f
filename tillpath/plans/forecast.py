"""Monthly series to validated forecasts, many series at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tillpath.config import DEFAULTS, Settings
from tillpath.operators import forecasting, series
from tillpath.session import cut


@dataclass(frozen=True)
class ForecastResult:
    series: DataFrame
    anomalies: DataFrame
    predictions: DataFrame
    comparison: DataFrame
    best: DataFrame
    forecast: DataFrame


def run_forecast(
    monthly: DataFrame,
    settings: Settings = DEFAULTS,
    *,
    models: tuple[str, ...] = forecasting.MODELS,
) -> ForecastResult:
    """`monthly` holds (series_key, month, value); series with gaps are reported, not fitted."""
    grid = cut(series.regular_grid(series.drop_truncated_month(monthly, settings)))
    predictions = cut(forecasting.walk_forward(grid, models, settings.folds))
    comparison = series.forecast_scores(predictions)
    best = cut(series.best_forecaster(comparison))
    return ForecastResult(
        series=grid,
        anomalies=series.anomalies(series.decompose(grid)),
        predictions=predictions,
        comparison=comparison,
        best=best,
        forecast=forecasting.forecast(grid, best, settings),
    )
