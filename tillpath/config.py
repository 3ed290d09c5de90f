"""Thresholds of the platform, all of them arguments with a default."""

from __future__ import annotations

from dataclasses import dataclass, field

from tillpath import fixed_values


@dataclass(frozen=True)
class Settings:
    # cleaning
    non_product_codes: tuple[str, ...] = tuple(fixed_values.NON_PRODUCT_CODES)
    min_price: float = 0.001
    cap_low: float = 0.01
    cap_high: float = 0.99
    # customer analytics
    churn_days: int = 90
    rfm_groups: int = 5
    # models
    seed: int = 42
    test_share: float = 0.2
    tier_high: float = 0.7
    tier_medium: float = 0.4
    cost_fp: float = 10.0
    cost_fn: float = 100.0
    segments: int = 4
    # forecasting
    horizon: int = 6
    folds: int = 6
    truncated_below: float = 0.5
    region_of: dict[str, str] = field(default_factory=lambda: dict(fixed_values.COUNTRY_REGION))


DEFAULTS = Settings()
