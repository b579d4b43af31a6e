"""Drift between a reference table and a new one, one row per feature."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import doubles, long_numbers, long_text, named, numbered, numeric_columns, per_column, safe_divide, union_all
from ..functions.ordered import running_by_value
from .profile import bin_counts, describe
from .select import above_mean, split_at_mean_time

FLOOR = 1e-10


def _shared(reference: DataFrame, new: DataFrame, columns: Sequence[str] | None, numeric: bool) -> list[str]:
    if columns is not None:
        return list(columns)
    numbers = set(numeric_columns(reference, with_bool=True))
    return [c for c in reference.columns if c in new.columns and (c in numbers) == numeric]


def _side_counts(reference: DataFrame, new: DataFrame, columns: Sequence[str], text: bool) -> DataFrame:
    """feature (its number), value, ref, new: rows with each value on either side, in one shuffle."""
    cells = long_text if text else long_numbers
    tagged = cells(reference, columns).select("*", F.lit(1).alias("_r"), F.lit(0).alias("_n")).unionByName(
        cells(new, columns).select("*", F.lit(0).alias("_r"), F.lit(1).alias("_n"))
    )
    return (
        tagged.where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.sum("_r").alias("ref"), F.sum("_n").alias("new"))
    )


def kolmogorov_tail(statistic: Column, ref_rows: Column, new_rows: Column, terms: int = 12) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    size = F.sqrt(safe_divide(ref_rows * new_rows, ref_rows + new_rows))
    x = (size + 0.12 + safe_divide(F.lit(0.11), size)) * statistic
    series = F.lit(0.0)
    for k in range(1, terms + 1):
        series = series + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * x * x)
    tail = F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))
    return F.when(x.isNull(), F.lit(None)).when(x < 0.3, F.lit(1.0)).otherwise(tail)


def ks_drift(reference: DataFrame, new: DataFrame, columns: Sequence[str] | None = None,
             threshold: float = 0.05, buckets: int | None = None) -> DataFrame:
    """feature, ref_rows, new_rows, statistic, p_value, has_drift by the two-sample Kolmogorov-Smirnov test."""
    columns = _shared(reference, new, columns, numeric=True)
    counts = _side_counts(reference, new, columns, text=False)
    ranked = running_by_value(counts, ["feature"], "value", ["ref", "new"], buckets)
    gap = F.abs(safe_divide(F.col("upto_ref"), F.col("total_ref")) - safe_divide(F.col("upto_new"), F.col("total_new")))
    found = ranked.groupBy("feature").agg(
        F.max("total_ref").alias("ref_rows"), F.max("total_new").alias("new_rows"), F.max(gap).alias("statistic")
    )
    found = named(found, columns)
    p_value = kolmogorov_tail(F.col("statistic"), F.col("ref_rows"), F.col("new_rows"))
    return found.withColumn("p_value", p_value).withColumn(
        "has_drift", F.coalesce(F.col("p_value") < threshold, F.lit(False))
    )


def drift_detected(scores: DataFrame) -> DataFrame:
    """features, drifted, drift_detected: the table-wide flag is any feature's."""
    return scores.agg(
        F.count("*").alias("features"),
        F.count_if("has_drift").alias("drifted"),
        F.coalesce(F.bool_or("has_drift"), F.lit(False)).alias("drift_detected"),
    )


def kl_drift(reference: DataFrame, new: DataFrame, columns: Sequence[str] | None = None,
             bins: int = 50, mode: str = "shared") -> DataFrame:
    """feature, score: Kullback-Leibler divergence of two histograms.

    shared: both tables over one set of edges, as probabilities. own: each
    table over its own edges, as densities.
    """
    if mode not in ("shared", "own"):
        raise ValueError(f"unknown mode: {mode}")
    columns = _shared(reference, new, columns, numeric=True)

    def edges(df: DataFrame) -> DataFrame:
        return per_column(doubles(df, columns), columns, {"lo": F.min, "hi": F.max})

    ref_edges, new_edges = edges(reference), edges(new)
    if mode == "shared":
        both = ref_edges.unionByName(new_edges)
        ref_edges = new_edges = both.groupBy("feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def shares(df: DataFrame, df_edges: DataFrame, name: str) -> DataFrame:
        counts = named(bin_counts(long_numbers(df, columns), numbered(df_edges, columns), bins), columns)
        totals = counts.groupBy("feature").agg(F.sum("n").alias("_t"))
        height = safe_divide(F.col("n"), F.col("_t"))
        if mode == "own":
            height = safe_divide(height, F.col("high") - F.col("low"))
        # One row per feature, and below one row per feature and bin.
        return counts.join(F.broadcast(totals), "feature").select("feature", "bin", height.alias(name))

    grid = ref_edges.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    heights = (
        grid.join(shares(reference, ref_edges, "p"), ["feature", "bin"], "left")
        .join(shares(new, new_edges, "q"), ["feature", "bin"], "left")
        .select("feature", *[F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(FLOOR)).alias(c) for c in ("p", "q")])
    )
    return heights.groupBy("feature").agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("score"))


def category_shares(reference: DataFrame, new: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, value, p, q: shares over the union of categories, absent ones 0."""
    columns = _shared(reference, new, columns, numeric=False)
    counts = _side_counts(reference, new, columns, text=True)
    totals = counts.groupBy("feature").agg(F.sum("ref").alias("_r"), F.sum("new").alias("_n"))
    # One row per feature.
    return named(counts.join(F.broadcast(totals), "feature"), columns).select(
        "feature",
        "value",
        F.coalesce(safe_divide(F.col("ref"), F.col("_r")), F.lit(0.0)).alias("p"),
        F.coalesce(safe_divide(F.col("new"), F.col("_n")), F.lit(0.0)).alias("q"),
    )


def category_drift(reference: DataFrame, new: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, score: mean absolute difference of category shares."""
    shares = category_shares(reference, new, columns)
    return shares.groupBy("feature").agg(F.avg(F.abs(F.col("p") - F.col("q"))).alias("score"))


def drift_scores(reference: DataFrame, new: DataFrame, columns: Sequence[str] | None = None,
                 bins: int = 50, mode: str = "shared") -> DataFrame:
    """feature, score: divergence for numbers, share difference for everything else."""
    columns = [c for c in reference.columns if c in new.columns] if columns is None else list(columns)
    numbers = set(numeric_columns(reference, with_bool=True))
    parts = []
    if any(c in numbers for c in columns):
        parts.append(kl_drift(reference, new, [c for c in columns if c in numbers], bins, mode))
    if any(c not in numbers for c in columns):
        parts.append(category_drift(reference, new, [c for c in columns if c not in numbers]))
    return union_all(parts)


def _upper_gamma(a: float, x: float) -> float:
    """Upper tail of the regularised gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2
        d = 1.0 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def chi_square_tail(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    """p-value of a chi-square statistic; used on one row per feature."""
    values = [np.nan if pd.isna(s) or k < 1 else _upper_gamma(k / 2, s / 2) for s, k in zip(statistic, freedom)]
    return pd.Series(values, dtype="float64").where(lambda v: v.notna(), None)


def chi_square_drift(reference: DataFrame, new: DataFrame, columns: Sequence[str] | None = None,
                     threshold: float = 0.05) -> DataFrame:
    """feature, statistic, freedom, p_value, has_drift, every column taken as categories.

    A feature drifts when its p-value is below threshold / number of features.
    """
    columns = [c for c in reference.columns if c in new.columns] if columns is None else list(columns)
    counts = _side_counts(reference, new, columns, text=True)
    totals = counts.groupBy("feature").agg(
        F.sum("ref").cast("double").alias("_r"), F.sum("new").cast("double").alias("_n")
    )
    rows = F.col("_r") + F.col("_n")
    seen = (F.col("ref") + F.col("new")).cast("double")
    want_ref, want_new = seen * F.col("_r") / rows, seen * F.col("_n") / rows
    miss = lambda got, want: F.try_divide((got - want) * (got - want), want)
    # One row per feature is broadcast.
    per_value = counts.join(F.broadcast(totals), "feature").select(
        "feature", (miss(F.col("ref"), want_ref) + miss(F.col("new"), want_new)).alias("part")
    )
    found = per_value.groupBy("feature").agg(
        F.sum("part").alias("statistic"), (F.count("*") - 1).cast("int").alias("freedom")
    )
    return named(found, columns).withColumn("p_value", chi_square_tail("statistic", "freedom")).withColumn(
        "has_drift", F.coalesce(F.col("p_value") < threshold / max(1, len(columns)), F.lit(False))
    )


def period_drift(log: DataFrame, ts: str, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """feature, score between the rows before and after the mean time, the largest first."""
    halves = split_at_mean_time(log, ts)
    scores = drift_scores(halves.where("period = 1"), halves.where("period = 2"), columns, bins)
    return scores.orderBy(F.desc_nulls_last("score"), "feature")


def drifting_features(scores: DataFrame) -> DataFrame:
    """Features whose score is above the mean score."""
    return above_mean(scores, "score")


def period_statistics(log: DataFrame, ts: str, columns: Sequence[str]) -> DataFrame:
    """``describe`` for both halves."""
    halves = split_at_mean_time(log, ts)
    parts = [
        describe(halves.where(F.col("period") == p), columns).withColumn("period", F.lit(p)) for p in (1, 2)
    ]
    return union_all(parts)


def drift_by_role(reference: DataFrame, new: DataFrame, features: Sequence[str], target: str | None = None,
                  prediction: str | None = None) -> DataFrame:
    """role, feature, score for the features, the target and the prediction, in one pass over each table."""
    roles = {**dict.fromkeys(features, "feature"), **({target: "target"} if target else {}),
             **({prediction: "prediction"} if prediction else {})}
    names = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    return drift_scores(reference, new, list(roles)).select(names[F.col("feature")].alias("role"), "feature", "score")


# A monitor of the user's own: (reference, new) -> rows of feature, score.
Monitor = Callable[[DataFrame, DataFrame], DataFrame]


def run_monitors(reference: DataFrame, new: DataFrame, monitors: dict[str, Monitor]) -> DataFrame:
    """monitor, feature, score from every registered monitor."""
    parts = [fn(reference, new).select(F.lit(name).alias("monitor"), "feature", "score") for name, fn in monitors.items()]
    return union_all(parts)
