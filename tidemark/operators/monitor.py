"""Monitoring of scored rows: performance, metric series, alerts, update decisions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import safe_divide
from ..functions.ordered import BUCKET, KEY, add_value_buckets, number_by_time
from ..functions.scratch import bucket_count, cut, join_lookup
from .drift import drift_detected, ks_drift
from .evaluate import classification_metrics, regression_columns

# The optimizer limits a ranked window before its shuffle up to this rank.

# A metric of the user's own: (label, prediction) -> aggregate expression.
Metric = Callable[[Column, Column], Column]


def _default_metric(task: str, label: str, prediction: str) -> Column:
    if task == "classification":
        return F.avg((F.col(label) == F.col(prediction)).cast("double"))
    return regression_columns(label, prediction)["r2"]


def performance_check(df: DataFrame, label: str, prediction: str, best_score: float, task: str = "classification",
                      metric: Metric | None = None, threshold: float = 0.1) -> DataFrame:
    """current_score, performance_drop, requires_retraining."""
    score = metric(F.col(label), F.col(prediction)) if metric else _default_metric(task, label, prediction)
    drop = F.lit(float(best_score)) - F.col("current_score")
    return df.agg(score.alias("current_score")).select(
        "current_score", drop.alias("performance_drop"), (drop > threshold).alias("requires_retraining")
    )


def prediction_statistics(df: DataFrame, prediction: str, label: str | None = None, few_labels: int = 10) -> DataFrame:
    """mean, population std, min, max; plus accuracy and weighted f1 for few label values, else mse and r2."""
    p = F.col(prediction).cast("double")
    stats = [F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max")]
    if label is None:
        return df.agg(*stats)
    # Enough to know whether there are few; never more than that many values.
    values = df.select(label).where(F.col(label).isNotNull()).distinct().limit(few_labels).count()
    if values < few_labels:
        scores = classification_metrics(df, label, prediction).select("accuracy", F.col("f1").alias("f1_score"))
        return df.agg(*stats).withColumn("_k", F.lit(1)).join(scores.withColumn("_k", F.lit(1)), "_k").drop("_k")
    both = regression_columns(label, prediction)
    return df.agg(*stats, both["mse"].alias("mse"), both["r2"].alias("r2"))


def monitoring_report(reference: DataFrame, new: DataFrame, features: Sequence[str],
                      performance: DataFrame | None = None, threshold: float = 0.05) -> DataFrame:
    """One row: drift flag, number of drifted features, row count, performance drop (null without labels)."""
    drift = drift_detected(ks_drift(reference, new, features, threshold)).select("drift_detected", "drifted")
    size = new.agg(F.count("*").alias("data_size"))
    out = drift.withColumn("_k", F.lit(1)).join(size.withColumn("_k", F.lit(1)), "_k")
    if performance is None:
        out = out.withColumn("performance_drop", F.lit(None).cast("double"))
    else:
        out = out.join(performance.select("performance_drop").withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def should_update(report: DataFrame, now: dt.datetime, last_update: dt.datetime | Column | None = None,
                  least_rows: int = 1000, most_drop: float = 0.1,
                  every: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """Add ``reason`` and ``update``: too soon and too few rows come before drift and performance."""
    last = F.lit(last_update).cast("timestamp") if not isinstance(last_update, Column) else last_update
    reason = (
        F.when(F.lit(now).cast("timestamp") - last < F.lit(every), "too soon")
        .when(F.col("data_size") < least_rows, "too few rows")
        .when(F.col("drift_detected"), "drift")
        .when(F.col("performance_drop") > most_drop, "performance")
        .otherwise("none")
    )
    return report.withColumn("reason", reason).withColumn("update", F.col("reason").isin("drift", "performance"))


OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "greater_than": lambda value, limit: value > limit,
    "less_than": lambda value, limit: value < limit,
    "equal": lambda value, limit: value == limit,
}


def check_alerts(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """alert_id, model_id, conditions, fires: active alerts all of whose conditions hold.

    A condition on an absent metric is skipped, one with an unknown operator passes.
    """
    value, limit = F.col("value"), F.col("threshold")
    held = F.lit(True)
    for name, test in OPERATORS.items():
        held = F.when(F.col("operator") == name, test(value, limit)).otherwise(held)
    joined = join_lookup(rules.where("is_active"), metrics, ["model_id", "metric"], "left")
    return joined.groupBy("alert_id", "model_id").agg(
        F.count("*").alias("conditions"), F.bool_and(F.coalesce(held, F.lit(True))).alias("fires")
    )


def notifications(fired: DataFrame, rules: DataFrame, models: DataFrame, metrics: DataFrame) -> DataFrame:
    """alert_id, model_id, message for every alert that fires, with the model's name and its metrics."""
    kinds = rules.groupBy("alert_id").agg(F.first("type").alias("type"))
    # A model reports a handful of metrics, so the list per model stays short.
    line = F.concat(F.lit("- "), "metric", F.lit(": "), F.round("value", 4).cast("string"))
    lines = metrics.groupBy("model_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    named = join_lookup(fired.where("fires"), models.select("model_id", "name"), ["model_id"], "left")
    head = F.concat(F.lit("alert: "), "type", F.lit("\nmodel: "), F.coalesce("name", F.lit("?")), F.lit("\n"))
    return named.join(kinds, "alert_id").join(lines, "model_id", "left").select(
        "alert_id", "model_id", F.concat(head, F.coalesce("lines", F.lit(""))).alias("message")
    )


def unread(sent: DataFrame, reads: DataFrame) -> DataFrame:
    """Notifications without a row in the append-only table of reads."""
    return sent.join(reads.select("id").distinct(), "id", "left_anti")


def series_changes(df: DataFrame, keys: Sequence[str], ts: str, value: str, tie: str, buckets: int | None = None) -> DataFrame:
    """The rows with ``previous`` and ``change`` along each series.

    The time axis is cut into ranges of about equal size; the first row of a
    range takes its previous value from the last row of an earlier one, so a
    long series is not sorted in one task.
    """
    seconds = F.col(ts).cast("timestamp").cast("double")
    timed = df.withColumn("_t", seconds)
    timed = cut(timed)
    buckets = bucket_count(timed.count()) if buckets is None else buckets
    if buckets > 1:
        timed = add_value_buckets(timed, "_t", buckets)
    else:
        timed = timed.withColumn(BUCKET, F.lit(0.0))
    timed = timed.withColumn(KEY, F.struct(*keys))
    inside = F.lag(value).over(W.partitionBy(KEY, BUCKET).orderBy("_t", tie))
    first = F.row_number().over(W.partitionBy(KEY, BUCKET).orderBy("_t", tie)) == 1
    local = timed.select("*", inside.alias("_inside"), first.alias("_first"))
    if buckets > 1:
        # One row per series and range.
        ends = timed.groupBy(KEY, BUCKET).agg(F.max_by(F.struct(value), F.struct("_t", tie)).alias("_end"))
        before = F.lag(F.col("_end")[value]).over(W.partitionBy(KEY).orderBy(BUCKET))
        local = local.join(ends.select(KEY, BUCKET, before.alias("_before")), [KEY, BUCKET])
        previous = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_inside"))
    else:
        previous = F.col("_inside")
    return local.select(*df.columns, previous.alias("previous"), (F.col(value) - previous).alias("change"))


def latest_and_change(df: DataFrame, keys: Sequence[str], ts: str, value: str, tie: str) -> DataFrame:
    """latest, change since the first row, per series: two ordered picks in one aggregate."""
    order = F.struct(ts, tie)
    latest, earliest = F.max_by(value, order), F.min_by(value, order)
    return df.groupBy(*keys).agg(latest.alias("latest"), (latest - earliest).alias("change"))


def metric_summary(long: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """best (largest), worst, mean, sample std per metric."""
    return long.groupBy(*keys).agg(
        F.max(value).alias("best"), F.min(value).alias("worst"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def resource_summary(df: DataFrame, ts: str, measures: Sequence[str], tie: str) -> DataFrame:
    """measure, current, mean, peak, n."""
    order = F.struct(ts, tie)
    row = df.agg(
        *[
            F.struct(
                F.lit(m).alias("measure"),
                F.max_by(m, order).alias("current"),
                F.avg(m).alias("mean"),
                F.max(m).alias("peak"),
                F.count(m).alias("n"),
            ).alias(f"s_{i}")
            for i, m in enumerate(measures)
        ]
    )
    return row.select(F.inline(F.array(*[F.col(f"s_{i}") for i in range(len(measures))])))


def prediction_log_summary(df: DataFrame, ok: str = "ok") -> DataFrame:
    """rows, success_rate, mean_confidence, uncertain: rows with confidence below one half."""
    return df.agg(
        F.count("*").alias("rows"),
        F.avg((F.col("status") == ok).cast("int")).alias("success_rate"),
        F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("confidence") < 0.5).alias("uncertain"),
    )


def last_rows(df: DataFrame, keys: Sequence[str], ts: str, tie: str, n: int = 1000) -> DataFrame:
    """The n newest rows of every series, without moving the log.

    Rows are counted by series and time range. Ranges that are kept whole are a
    filter; only the rows of the one range where the n-th newest falls are
    ranked, so neither n nor a long series decides how much one task sorts.
    Ranges hold about equally many rows, however far off some times are.
    """
    seconds = F.col(ts).cast("timestamp").cast("double")
    timed = df.withColumns({"_t": -seconds, KEY: F.struct(*keys)})
    rows = timed.count()
    if not rows:
        return df
    ranged = add_value_buckets(timed, "_t", 64 * bucket_count(rows))
    # Rows without a time are the oldest, in a range of their own.
    timed = ranged.withColumn(BUCKET, F.when(F.col("_t").isNull(), F.lit(float("inf"))).otherwise(F.col(BUCKET)))
    cells = timed.groupBy(KEY, BUCKET).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(KEY).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, W.currentRow))
    newest = cells.select(KEY, BUCKET, "_n", upto.alias("_upto")).where(F.col("_upto") - F.col("_n") < n)
    edge = newest.groupBy(KEY).agg(
        F.max(BUCKET).alias("_last"), F.max_by(F.lit(n) - (F.col("_upto") - F.col("_n")), BUCKET).alias("_left")
    )
    marked = join_lookup(timed, edge, [KEY])
    whole = marked.where(F.col(BUCKET) < F.col("_last"))
    place = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc(ts), F.desc(tie)))
    part = marked.where(F.col(BUCKET) == F.col("_last")).withColumn("_p", place).where(F.col("_p") <= F.col("_left"))
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def attach_labels(predictions: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Predictions with the labels known so far; the rest stay null."""
    return predictions.join(labels, list(on), "left")


def keep_since(df: DataFrame, ts: str, now: dt.datetime, days: int = 90) -> DataFrame:
    """Rows inside the retention time."""
    return df.where(F.col(ts) >= F.lit(now - dt.timedelta(days=days)).cast(df.schema[ts].dataType))


def label_share(df: DataFrame, label: str) -> DataFrame:
    """rows, labelled, share of the predictions whose label has arrived."""
    return df.agg(
        F.count("*").alias("rows"), F.count(label).alias("labelled"), safe_divide(F.count(label), F.count("*")).alias("share")
    )
