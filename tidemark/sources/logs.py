"""Append-only log tables, partitioned by day."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "models": """id bigint, name string, version string, model_type string, created_at timestamp, updated_at timestamp,
        hyperparameters map<string,string>, metrics map<string,double>, feature_importance map<string,double>,
        path string, preprocessing map<string,string>""",
    "training_logs": "id bigint, model_id bigint, ts timestamp, event_type string, details map<string,string>",
    "performance_logs": "id bigint, model_id bigint, ts timestamp, metrics map<string,double>",
    "prediction_logs": """id bigint, model_id bigint, ts timestamp, prediction double, actual double,
        features map<string,double>, confidence double, status string""",
    "resource_logs": "id bigint, ts timestamp, memory_usage double, cpu_usage double, disk_usage double, response_time double",
    "alerts": """alert_id bigint, model_id bigint, type string, metric string, operator string, threshold double,
        channels array<string>, is_active boolean, created_at timestamp""",
    "notifications": "id bigint, alert_id bigint, message string, created_at timestamp, is_read boolean",
    "reads": "id bigint, ts timestamp",
    "tombstones": "model_id bigint, ts timestamp",
}


def log_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def append_log(df: DataFrame, root: str, name: str, ts: str = "ts") -> None:
    """Append a batch of rows. Never called per row: every call writes files.

    The batch is written to a folder of its own and its files are moved in, so
    that writers at the same time do not clear away each other's work.
    """
    fields = log_schema(name).fields
    shaped = df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )
    staged = f"{root}/.staged/{name}-{uuid.uuid4().hex}"
    shaped.withColumn("day", F.to_date(ts)).write.partitionBy("day").parquet(staged)
    move_files(df.sparkSession, staged, f"{root}/{name}")


def move_files(spark: SparkSession, source: str, target: str) -> None:
    """Move the files of a written, partitioned table into another one; names of files are unique."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    origin = path(source)
    fs = origin.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(origin):
        if not folder.isDirectory():
            continue
        into = path(f"{target}/{folder.getPath().getName()}")
        fs.mkdirs(into)
        for file in fs.listStatus(folder.getPath()):
            if not fs.rename(file.getPath(), path(into, file.getPath().getName())):
                raise OSError(f"could not move {file.getPath()}")
    fs.mkdirs(path(target))
    fs.delete(origin, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The whole log, or an empty table before the first append."""
    path = f"{root}/{name}"
    schema = log_schema(name)
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("day", F.lit(None).cast("date"))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.DateType())])).parquet(path)


def scan_log(spark: SparkSession, root: str, name: str, start: dt.datetime, end: dt.datetime,
             model_id: int | None = None, ts: str = "ts") -> DataFrame:
    """Rows of an inclusive time range in time order. Only the days of the range are opened."""
    rows = read_log(spark, root, name).where(F.col("day").between(F.lit(start.date()), F.lit(end.date())))
    rows = rows.where(F.col(ts).between(F.lit(start), F.lit(end)))
    if model_id is not None:
        rows = rows.where(F.col("model_id") == model_id)
    return rows.drop("day").orderBy(ts, "id")


def spread_map(df: DataFrame, column: str, names: Sequence[str] | None = None) -> DataFrame:
    """A map column as one column per key; the keys are found in one pass unless given."""
    if names is None:
        keys = df.select(F.explode(F.map_keys(column)).alias("k")).distinct()
        names = sorted(r["k"] for r in keys.collect())
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.col(column)[n].alias(n) for n in names])


def map_long(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """keep, metric, value: a map column as rows."""
    return df.select(*keep, F.explode(column).alias("metric", "value"))


def drop_old_days(df: DataFrame, now: dt.datetime, days: int = 90) -> DataFrame:
    """The rows of the days kept; a partition filter, so old files are not read."""
    return df.where(F.col("day") >= F.lit((now - dt.timedelta(days=days)).date()))
