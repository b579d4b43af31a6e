"""Reading tables from files and records, and writing predictions."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.prepare import default_cleaning

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header. Types are inferred (one more pass over the file) unless a schema is given."""
    reader = spark.read.options(**{"header": True, **options})
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Any known format, picked by the extension."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise ValueError(f"unsupported file format: {extension or path}")
    if FORMATS[extension] == "csv":
        return read_csv(spark, path, schema, **options)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(FORMATS[extension]).load(path)


def load_clean(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table read by extension, refused when empty, and cleaned by the default rules."""
    df = read_table(spark, path, schema, **options)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return default_cleaning(df)


def from_records(spark: SparkSession, records: Sequence[dict], schema: T.StructType | str | None = None) -> DataFrame:
    """A handful of JSON-like records as a table; larger sets belong in files."""
    if not records:
        raise ValueError("no records")
    if schema is None:
        names = list(dict.fromkeys(k for r in records for k in r))
        rows = [tuple(r.get(n) for n in names) for r in records]
        return spark.createDataFrame(rows, names)
    return spark.createDataFrame(list(records), schema)


def preview(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first rows by an explicit key, as tables have no row order."""
    return df.orderBy(order).limit(n)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One file set; a rerun replaces it, so a retried job leaves no doubled rows."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
