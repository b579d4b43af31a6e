"""Projections and filters: column choice by type, time ranges, log filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import numeric_columns, present, safe_divide, time_columns, union_all
from ..functions.scratch import join_lookup
from .profile import null_counts

# Days back from now of each preset range.
TIME_RANGES = {"day": 1, "week": 7, "month": 30, "quarter": 90}


def column_types(df: DataFrame, target: str | None = None) -> dict[str, list[str]]:
    """Names by kind; booleans count as numerical, the target is left out."""
    skip = [target] if target else []
    numerical = numeric_columns(df, skip, with_bool=True)
    times = time_columns(df, skip)
    other = [c for c in df.columns if c not in {*numerical, *times, *skip}]
    return {"numerical": numerical, "categorical": other, "datetime": times}


def select_by_type(df: DataFrame, kind: str, target: str | None = None) -> DataFrame:
    return df.select(*column_types(df, target)[kind])


def feature_columns(df: DataFrame) -> list[str]:
    """Columns a model can take as they are: whole numbers, doubles, booleans."""
    kinds = (T.LongType, T.IntegerType, T.DoubleType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def default_features(df: DataFrame, target: str, n: int = 5) -> list[str]:
    return [c for c in feature_columns(df) if c != target][:n]


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def drop_sparse_columns(df: DataFrame, most_missing: float = 0.5) -> DataFrame:
    """Without the columns whose missing share is above the limit."""
    limit = safe_divide(F.col("missing"), F.col("rows")) > most_missing
    return df.drop(*[r["feature"] for r in null_counts(df).where(limit).collect()])


def last_days(df: DataFrame, ts: str, now: dt.datetime, days: int | str) -> DataFrame:
    """Rows of the range that ends at ``now``, both ends included.

    The bounds are literals of the column's own type, so they reach the scan.
    """
    days = TIME_RANGES[days] if isinstance(days, str) else days
    kind = df.schema[ts].dataType
    low, high = (F.lit(t).cast(kind) for t in (now - dt.timedelta(days=days), now))
    return df.where(F.col(ts).between(low, high))


def recent_counts(df: DataFrame, ts: str, now: dt.datetime, hours: int = 24) -> DataFrame:
    """total, recent: all rows, and those of the last hours."""
    since = F.lit(now - dt.timedelta(hours=hours)).cast(df.schema[ts].dataType)
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(ts) > since).alias("recent"))


def filter_predictions(df: DataFrame, least_confidence: float, statuses: Sequence[str]) -> DataFrame:
    kept = (F.col("confidence") >= least_confidence) & F.col("status").isin(*statuses)
    return df.where(kept).select("ts", "input", "prediction", "confidence", "status")


def metric_anomalies(df: DataFrame, value: str, keys: Sequence[str] = (), deviations: float = 2.0) -> DataFrame:
    """Rows further than some sample standard deviations from the mean of their series."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    if keys:
        joined = join_lookup(df, stats, list(keys))
        far = F.abs(F.col(value) - F.col("_mean")) > deviations * F.col("_std")
        return joined.where(far).select(*df.columns)
    row = stats.first()
    if row["_std"] is None:
        return df.where(F.lit(False))
    return df.where(F.abs(F.col(value) - row["_mean"]) > deviations * row["_std"])


def above_mean(df: DataFrame, value: str) -> DataFrame:
    """Rows above the mean of the column, for example of drift scores."""
    return df.where(F.col(value) > df.agg(F.avg(value)).scalar())


def split_at_mean_time(df: DataFrame, ts: str) -> DataFrame:
    """Add ``period``: 1 before the mean time, 2 from it on."""
    seconds = F.col(ts).cast("timestamp").cast("double")
    middle = df.agg(F.avg(seconds)).first()[0]
    return df.withColumn("period", F.when(seconds < F.lit(middle), 1).otherwise(2))


def metric_rows(df: DataFrame, metric: str, others: bool = False) -> DataFrame:
    same = F.col("metric") == metric
    return df.where(~same if others else same)


def scoring_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The training columns in training order, or an error that names those absent."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.select(*required)


def column_match(df: DataFrame, training_columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns missing from the table, and columns training did not know."""
    have, want = set(df.columns), set(training_columns)
    return sorted(want - have), sorted(have - want)


def storage_safe(df: DataFrame, text_fill: str = "NA", number_fill: int = -999) -> DataFrame:
    """Texts and times as strings with a fill text, numbers with a fill number."""
    numbers = set(numeric_columns(df))

    def fixed(c: str) -> Column:
        if c in numbers:
            kind = df.schema[c].dataType
            return F.coalesce(present(df, c), F.lit(number_fill).cast(kind)).alias(c)
        return F.coalesce(F.col(c).cast("string"), F.lit(text_fill)).alias(c)

    return df.select(*[fixed(c) for c in df.columns])


def to_float32(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def history_view(models: DataFrame) -> DataFrame:
    """Model versions with minute-precision time texts, the newest first."""
    minute = lambda c: F.date_format(F.col(c), "yyyy-MM-dd HH:mm")
    return models.orderBy(F.desc("created_at"), F.desc("id")).select(
        "name", "version", "model_type", minute("created_at").alias("created"), minute("updated_at").alias("updated")
    )


def type_overview(df: DataFrame, target: str | None = None) -> DataFrame:
    """kind, feature, n: the columns of every kind with their non-null counts."""
    parts = []
    for kind, names in column_types(df, target).items():
        if names:
            counts = null_counts(df, names)
            parts.append(counts.select(F.lit(kind).alias("kind"), "feature", (F.col("rows") - F.col("missing")).alias("n")))
    return union_all(parts)


