"""The monitoring of a prediction log as Structured Streaming.

Every function takes a DataFrame and returns one, so that the same code runs
on a stream and on a static table.
"""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.drift import drift_scores, ks_drift
from ..operators.monitor import check_alerts
from ..sources.logs import exists


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A file source: every new file below ``path`` is read once."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def score(df: DataFrame, model: PipelineModel, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, "prediction")


def window_metrics(df: DataFrame, ts: str, keys: Sequence[str], value: str, width: str = "1 hour",
                   slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, window_end, keys, n, mean, std, min, max per time window.

    Rows later than ``late`` behind the newest one are dropped on a stream; a
    static table has no watermark.
    """
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if slide and not df.isStreaming and pd.Timedelta(width) % pd.Timedelta(slide) == pd.Timedelta(0):
        return _pane_metrics(timed, keys, value, width, slide)
    if df.isStreaming:
        timed = timed.withWatermark("_ts", late)
    frame = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    v = F.col(value).cast("double")
    stats = timed.groupBy(frame.alias("w"), *keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    return stats.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "mean", "std", "min", "max")


def _pane_metrics(timed: DataFrame, keys: Sequence[str], value: str, width: str, slide: str) -> DataFrame:
    """Sliding windows from disjoint panes of one slide.

    Every row is aggregated once; only the panes, not the rows, are repeated
    for the windows they lie in.
    """
    v = F.col(value).cast("double")
    panes = timed.groupBy(F.window("_ts", slide).alias("p"), *keys).agg(
        F.count("*").alias("rows"), F.count(v).alias("c"), F.avg(v).alias("m"), F.var_pop(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )
    placed = panes.select(F.window("p.start", width, slide).alias("w"), *keys, "rows", "c", "m", "s", "lo", "hi")
    # Spread of the whole: spread inside the panes and of their means around a
    # mean of the key, which keeps the squares small.
    center = placed.groupBy(*keys).agg(F.avg("m").alias("_center"))
    placed = placed.join(center, list(keys)) if keys else placed.withColumn("_center", F.lit(0.0))
    d = F.col("m") - F.col("_center")
    n, first, second = F.sum("c"), F.sum(F.col("c") * d), F.sum(F.col("c") * (F.col("s") + d * d))
    square = F.greatest(F.lit(0.0), second - F.try_divide(first * first, n))
    stats = placed.groupBy("w", *keys).agg(
        F.sum("rows").alias("n"), (F.try_divide(first, n) + F.first("_center")).alias("mean"),
        F.when(n > 1, F.sqrt(square / (n - 1))).alias("std"), F.min("lo").alias("min"), F.max("hi").alias("max"),
    )
    return stats.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "mean", "std", "min", "max")


def join_late_labels(predictions: DataFrame, labels: DataFrame, key: str, ts: str, label_ts: str, label: str,
                     within: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Predictions with the label that arrives within a time bound, null when none does.

    Both sides carry a watermark and the condition bounds the wait, so that the
    state of a stream can be dropped.
    """
    p = predictions.withColumn("_pts", F.col(ts).cast("timestamp")).alias("p")
    l = labels.select(F.col(key).alias("_key"), F.col(label_ts).cast("timestamp").alias("_lts"), F.col(label)).alias("l")
    if predictions.isStreaming:
        p, l = p.withWatermark("_pts", late), l.withWatermark("_lts", late)
    bound = (F.col(key) == F.col("_key")) & (F.col("_lts") >= F.col("_pts")) & (
        F.col("_lts") <= F.col("_pts") + F.expr(f"INTERVAL {within}")
    )
    return p.join(l, bound, "leftOuter").drop("_key", "_pts", "_lts")


def batch_drift(reference: DataFrame, batch: DataFrame, columns: Sequence[str], batch_id: int) -> DataFrame:
    """batch_id, feature, score of one batch against the reference table."""
    return drift_scores(reference, batch, columns).select(F.lit(batch_id).cast("long").alias("batch_id"), "feature", "score")


def batch_alerts(rules: DataFrame, metrics: DataFrame, batch_id: int) -> DataFrame:
    fired = check_alerts(rules, metrics).where("fires")
    return fired.select(F.lit(batch_id).cast("long").alias("batch_id"), "alert_id", "model_id", "conditions")


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch: a replayed batch replaces its own rows."""
    df.drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def per_batch(stream: DataFrame, work: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str,
              trigger: dict | None = None) -> StreamingQuery:
    """Run ``work`` on every micro-batch and append its rows once per batch id."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            if not held.isEmpty():
                _write_batch(work(held, batch_id), path, batch_id)
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drift_stream(stream: DataFrame, reference: DataFrame, columns: Sequence[str], path: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    return per_batch(stream, lambda b, i: batch_drift(reference, b, columns, i), path, checkpoint, trigger)


def ks_stream(stream: DataFrame, reference: DataFrame, columns: Sequence[str], path: str, checkpoint: str,
              trigger: dict | None = None) -> StreamingQuery:
    return per_batch(stream, lambda b, i: ks_drift(reference, b, columns), path, checkpoint, trigger)


def alert_stream(stream: DataFrame, rules: DataFrame, model: str | Column, metric: str, value: str, path: str,
                 checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Alerts over the mean of every model's metrics in a micro-batch."""
    key = F.col(model) if isinstance(model, str) else model

    def work(batch: DataFrame, batch_id: int) -> DataFrame:
        metrics = batch.groupBy(key.alias("model_id"), F.col(metric).alias("metric")).agg(F.avg(value).alias("value"))
        return batch_alerts(rules, metrics, batch_id)

    return per_batch(stream, work, path, checkpoint, trigger)


def append_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append finished rows to a Parquet folder."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class LateRows(StreamingQueryListener):
    """Adds up the rows that streams drop behind their watermark, from every trigger's progress.

    A query remembers the progress of its last triggers only; a listener is told
    of each. What is counted is kept per query and batch, so that a batch run
    again after a restart counts once, and is appended to the table at ``path``
    whenever ``flush_every`` batches have come in, and when a query ends.
    """

    SCHEMA = "query_id string, name string, batch_id long, ts timestamp, dropped long"

    def __init__(self, spark: SparkSession, path: str, flush_every: int = 50):
        super().__init__()
        self.spark, self.path, self.flush_every = spark, path, flush_every
        self.pending: list[tuple] = []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802 - names of the interface
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        dropped = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        with self.lock:
            self.pending.append((str(p.id), p.name, p.batchId, dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")), dropped))
            full = len(self.pending) >= self.flush_every
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()

    def flush(self) -> None:
        """Append what has come in to the table: one small file."""
        with self.lock:
            rows, self.pending = self.pending, []
        if rows:
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """query_id, batches, dropped: rows dropped behind the watermark, from the table of ``LateRows``."""
    if not exists(spark, path):
        return spark.createDataFrame([], "query_id string, batches long, dropped long")
    # A batch that no data asks for has a progress of its own under the next number, or none.
    per = spark.read.schema(LateRows.SCHEMA).parquet(path).groupBy("query_id", "batch_id").agg(F.max("dropped").alias("dropped"))
    return per.groupBy("query_id").agg(F.count("*").alias("batches"), F.sum("dropped").alias("dropped"))
