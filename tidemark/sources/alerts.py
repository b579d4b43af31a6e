"""Alert rules and notifications as append-only tables."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.monitor import unread
from .logs import append_log, log_schema, read_log


def create_alert(spark: SparkSession, root: str, model_id: int, kind: str, conditions: dict[str, dict],
                 channels: Sequence[str] = ("database",), now: dt.datetime | None = None) -> int:
    """Store a rule, one row per condition: {metric: {"operator": ..., "threshold": ...}}. Returns its id."""
    alert_id = time.time_ns() // 1000
    rows = [
        (alert_id, model_id, kind, metric, c["operator"], float(c["threshold"]), list(channels), True, now or dt.datetime.now())
        for metric, c in conditions.items()
    ]
    append_log(spark.createDataFrame(rows, log_schema("alerts")), root, "alerts", ts="created_at")
    return alert_id


def active_alerts(spark: SparkSession, root: str, model_id: int | None = None) -> DataFrame:
    rules = read_log(spark, root, "alerts").drop("day").where("is_active")
    return rules if model_id is None else rules.where(F.col("model_id") == model_id)


def store_notifications(sent: DataFrame, root: str, now: dt.datetime | None = None) -> None:
    """Append messages (alert_id, message). Their ids come from the alert and the time."""
    at = now or dt.datetime.now()
    rows = sent.select(
        F.xxhash64("alert_id", F.lit(at.isoformat())).alias("id"), "alert_id", "message",
        F.lit(at).alias("created_at"), F.lit(False).alias("is_read"),
    )
    append_log(rows, root, "notifications", ts="created_at")


def mark_as_read(spark: SparkSession, root: str, notification_ids: Sequence[int], now: dt.datetime | None = None) -> None:
    """Rows are only appended: a read is a row of its own."""
    rows = [(i, now or dt.datetime.now()) for i in notification_ids]
    append_log(spark.createDataFrame(rows, log_schema("reads")), root, "reads")


def unread_notifications(spark: SparkSession, root: str) -> DataFrame:
    sent = read_log(spark, root, "notifications").drop("day")
    return unread(sent, read_log(spark, root, "reads")).orderBy("created_at", "id")


def record_metrics(statistics: DataFrame, root: str, model_id: int, now: dt.datetime | None = None) -> None:
    """Append one row of statistics to the performance log, its numeric columns as a map."""
    numbers = [f.name for f in statistics.schema.fields if isinstance(f.dataType, T.NumericType)]
    pairs = F.create_map(*[x for c in numbers for x in (F.lit(c), F.col(c).cast("double"))])
    at = F.lit(now or dt.datetime.now())
    row = statistics.select(F.unix_micros(at.cast("timestamp")).alias("id"), F.lit(model_id).alias("model_id"), at.alias("ts"), pairs.alias("metrics"))
    append_log(row, root, "performance_logs")
