"""RFM scores to named segments in the customer feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tillpath.config import DEFAULTS, Settings
from tillpath.operators import segments
from tillpath.operators.customers import rfm_scores
from tillpath.operators.merging import empty_feature_table, merge_segments
from tillpath.schemas import Star
from tillpath.session import cut


@dataclass(frozen=True)
class Segmentation:
    sweep: DataFrame | None
    profiles: DataFrame
    customers: DataFrame
    feature_table: DataFrame


def run_segmentation(
    star: Star,
    table: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    *,
    sweep: bool = True,
    restarts: int = 10,
) -> Segmentation:
    """Score, cluster, profile, name, merge into `table` (a new one if none is given)."""
    scores = cut(rfm_scores(star.fact, star.dates, settings))
    tried = segments.kmeans_sweep(scores, settings=settings, restarts=restarts) if sweep else None
    fitted = segments.kmeans_fit(scores, settings=settings, restarts=restarts)
    clustered = cut(fitted.predict(scores))
    named = segments.segment_names(segments.segment_profiles(clustered))
    assigned = segments.assign_segments(clustered, named)
    old = empty_feature_table(scores) if table is None else table
    return Segmentation(tried, named, assigned, merge_segments(old, assigned))
