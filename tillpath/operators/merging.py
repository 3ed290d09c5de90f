"""Keyed merges into the customer feature table. Both return the new table; write it to a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.schemas import CUSTOMER_FEATURES

_SEGMENT_COLUMNS = [
    "recency_days", "frequency", "monetary", "rfm_segment", "cluster_id", "segment_name",
]
_FILLED_COLUMNS = [
    "avg_order_value", "return_rate", "product_diversity", "days_active", "purchase_trend",
]


def _shaped(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in CUSTOMER_FEATURES.fields])


def merge_segments(table: DataFrame, segments: DataFrame) -> DataFrame:
    """Upsert: known customers get new R/F/M, score and segment, new ones are added as not churned."""
    incoming = segments.select("customer_id", *_SEGMENT_COLUMNS)
    old, new = table.alias("old"), incoming.alias("new")
    merged = old.join(new, F.col("old.customer_id") == F.col("new.customer_id"), "full_outer")
    arrived = F.col("new.customer_id").isNotNull()
    columns = [F.coalesce("old.customer_id", "new.customer_id").alias("customer_id")]
    for name in CUSTOMER_FEATURES.names[1:]:
        if name in _SEGMENT_COLUMNS:
            value = F.when(arrived, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        elif name == "churn_label":
            added = F.col("old.customer_id").isNull()
            value = F.when(added, F.lit(False)).otherwise(F.col("old.churn_label"))
        else:
            value = F.col(f"old.{name}")
        columns.append(value.alias(name))
    return _shaped(merged.select(*columns))


def merge_scores(table: DataFrame, scores: DataFrame) -> DataFrame:
    """Update only: probability with four decimals and label = probability >= 0.5.

    Scores that were rounded before bring their label as `churn_predicted`. Scores of unknown
    customers are dropped.
    """
    p = F.col("churn_probability").cast("double")
    label = F.col("churn_predicted") if "churn_predicted" in scores.columns else p >= 0.5
    incoming = scores.select("customer_id", p.alias("p"), label.alias("_label"))
    joined = table.join(incoming, "customer_id", "left")
    scored = F.col("p").isNotNull()
    rounded = F.col("p").cast("decimal(5,4)")
    return _shaped(joined.withColumns({
        "churn_probability": F.when(scored, rounded).otherwise(F.col("churn_probability")),
        "churn_label": F.when(scored, F.col("_label")).otherwise(F.col("churn_label")),
    }))


def fill_features(table: DataFrame, features: DataFrame, diversity: DataFrame) -> DataFrame:
    """Fill the behavioural columns that segmentation leaves open, for customers of the table."""
    incoming = features.join(diversity, "customer_id", "left").select(
        "customer_id", *[F.col(c).alias(f"_new_{c}") for c in _FILLED_COLUMNS]
    )
    joined = table.join(incoming, "customer_id", "left")
    types = {f.name: f.dataType for f in CUSTOMER_FEATURES.fields}
    return _shaped(joined.withColumns({
        c: F.coalesce(F.col(f"_new_{c}").cast(types[c]), F.col(c)) for c in _FILLED_COLUMNS
    }))


def empty_feature_table(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], CUSTOMER_FEATURES)
