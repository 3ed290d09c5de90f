"""Batch jobs that chain the operators. Order: etl, then segmentation, then churn; the report and
the forecast need the star only."""
