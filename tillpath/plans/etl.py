"""Raw feed to validated star schema."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tillpath.config import DEFAULTS, Settings
from tillpath.operators.cleaning import clean_transactions
from tillpath.operators.star import (
    dim_customers,
    dim_dates,
    dim_products,
    fact_transactions,
)
from tillpath.operators.validation import all_passed, validation_report
from tillpath.session import scope, settled
from tillpath.sources.feeds import account, read_parts
from tillpath.sources.tables import read_star, write_dimension, write_fact


@dataclass(frozen=True)
class EtlResult:
    success: bool
    rows_loaded: dict[str, int]
    cleaning_report: DataFrame
    validation: DataFrame
    seconds: float = field(compare=False)
    # Lines of the feed, and how many of them did not fit; only where files were read.
    lines_read: int | None = None
    lines_refused: int | None = None


def run_etl(
    raw: DataFrame, root: str, settings: Settings = DEFAULTS, *, position: str | None = None
) -> EtlResult:
    """Clean, build, write to `root`, check what was written.

    All four tables are built from the cleaned lines, which are a map-side pass over the distinct
    lines that the cleaning has staged. Dimensions are written first; the fact takes its keys from
    the stored ones. What is staged on the way is removed at the end, after a failure too.
    """
    with scope(raw.sparkSession):
        return _run_etl(raw, root, settings, position)


def _run_etl(raw: DataFrame, root: str, settings: Settings, position: str | None) -> EtlResult:
    start = time.monotonic()
    cleaned = clean_transactions(raw, settings, position=position)
    lines = cleaned.lines
    built = {
        "dim_dates": dim_dates(lines),
        "dim_customers": dim_customers(lines, settings, position=position),
        "dim_products": dim_products(lines),
    }
    stored, loaded = {}, {}
    for name, table in built.items():
        stored[name], loaded[name] = write_dimension(table, root, name)
    fact = fact_transactions(
        lines, stored["dim_dates"], stored["dim_customers"], stored["dim_products"]
    )
    loaded["fact_transactions"] = write_fact(
        fact, stored["dim_dates"], os.path.join(root, "fact_transactions")
    )
    report = settled(validation_report(read_star(raw.sparkSession, root), loaded))
    outcome = all_passed(report).first()
    return EtlResult(
        success=bool(outcome["success"]),
        rows_loaded=loaded,
        cleaning_report=settled(cleaned.report),
        validation=report,
        seconds=round(time.monotonic() - start, 2),
    )


def run_etl_from_files(
    spark: SparkSession,
    paths: list[str],
    root: str,
    fmt: str = "csv",
    settings: Settings = DEFAULTS,
    *,
    multi_line: bool = False,
) -> EtlResult:
    """`run_etl` over files; the lines that do not fit are counted while the feed is read."""
    counts = account()
    raw = read_parts(spark, paths, fmt, position="source_position", multi_line=multi_line, counts=counts)
    result = run_etl(raw, root, settings, position="source_position")
    found = counts.get
    return replace(result, lines_read=found["lines_read"], lines_refused=found["lines_refused"])
