"""Reports and model comparisons as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMPARISON_SCHEMA = "model string, metric string, value double"


def save_report(report: DataFrame, path: str) -> str:
    """Write report rows as JSON lines; a rerun replaces them."""
    report.write.mode("overwrite").json(path)
    return path


def load_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read a report with its schema: maps and empty arrays cannot be inferred from JSON."""
    return spark.read.schema(schema).json(path)


def save_comparison(long: DataFrame, path: str) -> str:
    return save_report(long.select("model", "metric", "value"), path)


def load_comparison(spark: SparkSession, path: str) -> DataFrame:
    return load_report(spark, path, COMPARISON_SCHEMA)
