"""Tabular machine learning and data quality as Spark jobs."""
