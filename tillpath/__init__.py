"""Retail analytics as Spark jobs: cleaning, star schema, business reports, models, forecasts."""

from tillpath.config import Settings
from tillpath.schemas import Star

__all__ = ["Settings", "Star"]
