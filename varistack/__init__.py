"""Spark jobs for stacked regression, variance partitioning and training-data preparation."""
