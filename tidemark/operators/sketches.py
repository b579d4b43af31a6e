"""Distinct counts that can be kept and merged: one sketch per key and column.

A sketch has a fixed size whatever it has seen, and the sketch of two parts is
that of the whole. So the sketches of a day are made once, and the distinct
counts of any range of days come from merging a few rows, not from its data.
Merging a sketch with itself changes nothing, so a day may be recorded twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import PASS_WIDTH, present, union_all

#: Binary logarithm of a sketch's registers: 2**14 give a standard error of 0.8 %.
LG_REGISTERS = 14


def _countable(df: DataFrame, name: str) -> Column:
    """The value in a type that sketches take; equal values stay equal."""
    value, kind = present(df, name), df.schema[name].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return value
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # Zero has no sign.
        return (value + F.lit(0.0)).cast("string")
    return value.cast("string")


def distinct_sketches(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = (), lg: int = LG_REGISTERS) -> DataFrame:
    """keys, feature, rows, missing, sketch: one row per key and column.

    Sketches are filled in the tasks that read the rows, so what is shuffled is
    one sketch per task, key and column. A column that is missing throughout has
    an empty sketch.
    """
    columns = [c for c in df.columns if c not in keys] if columns is None else list(columns)
    parts = []
    for start in range(0, len(columns), PASS_WIDTH):
        chunk = columns[start : start + PASS_WIDTH]
        slim = df.select(*keys, *[_countable(df, c).alias(f"_v{i}") for i, c in enumerate(chunk)])
        made = slim.groupBy(*keys).agg(
            *[
                F.struct(
                    F.lit(c).alias("feature"), F.count("*").alias("rows"), F.count_if(F.col(f"_v{i}").isNull()).alias("missing"),
                    F.hll_sketch_agg(f"_v{i}", lg).alias("sketch"),
                ).alias(f"_s{i}")
                for i, c in enumerate(chunk)
            ]
        )
        parts.append(made.select(*keys, F.inline(F.array(*[F.col(f"_s{i}") for i in range(len(chunk))]))))
    return union_all(parts)


def merged_distinct(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature, rows, missing, distinct from the sketches of their parts."""
    merged = sketches.groupBy(*keys, "feature").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct")
    )
    return merged.select(*keys, "feature", "rows", "missing", "distinct")


def record_days(df: DataFrame, root: str, ts: str, columns: Sequence[str] | None = None, lg: int = LG_REGISTERS) -> None:
    """Make the sketches of every day in ``df`` and put them into the store, in place of those days' earlier ones.

    Every day's rows are expected to be complete. Other days are not touched.
    """
    columns = [c for c in df.columns if c != ts] if columns is None else columns
    daily = distinct_sketches(df.withColumn("day", F.to_date(ts)), columns, ["day"], lg)
    daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(root)


def profile_of_days(spark: SparkSession, root: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """feature, rows, missing, distinct of a range of recorded days, both ends included; only their folders are opened."""
    kept = spark.read.schema("feature string, rows long, missing long, sketch binary, day date").parquet(root)
    if first is not None:
        kept = kept.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        kept = kept.where(F.col("day") <= F.lit(last).cast("date"))
    return merged_distinct(kept)
