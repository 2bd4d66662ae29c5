"""Demand-grid analytics and data preparation, written for Spark's DataFrame engine."""
