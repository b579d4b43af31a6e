"""Versioned models: a directory per version and an append-only table of rows."""

from __future__ import annotations

import datetime as dt
import json
import random
import time
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import number_by_time
from .logs import append_log, exists, log_schema, read_log


def version_number(column: str = "version"):
    """v12 -> 12, so that v10 comes after v9."""
    return F.substring(F.col(column), 2, 18).cast("long")


def number_versions(models: DataFrame, name: str = "name", created: str = "created_at", tie: str = "id") -> DataFrame:
    """Add ``version`` v1, v2, ... per name in creation order."""
    numbered = number_by_time(models, [name], created, tie)
    return numbered.withColumn("version", F.concat(F.lit("v"), F.col("position").cast("string"))).drop("position")


def latest_versions(models: DataFrame) -> DataFrame:
    """name, id, version of the highest version number of every name."""
    order = F.struct(version_number(), F.col("id"))
    return models.groupBy("name").agg(F.max_by("id", order).alias("id"), F.max_by("version", order).alias("version"))


def model_names(models: DataFrame) -> DataFrame:
    return models.select("name").distinct().orderBy("name")


def live_models(models: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Models without a tombstone row."""
    return models.join(tombstones.select(F.col("model_id").alias("id")).distinct(), "id", "left_anti")


def newest_first(models: DataFrame, name: str | None = None) -> DataFrame:
    rows = models if name is None else models.where(F.col("name") == name)
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def version_metrics(models: DataFrame, metrics: list[str]) -> DataFrame:
    """name, version, one column per metric."""
    return models.select("name", "version", *[F.col("metrics")[m].alias(m) for m in metrics])


def update_status(models: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """name, versions, current_version, last_update; with the last report when given."""
    order = F.struct(version_number(), F.col("id"))
    out = models.groupBy("name").agg(
        F.count("*").alias("versions"),
        F.max_by("version", order).alias("current_version"),
        F.max("updated_at").alias("last_update"),
    )
    if reports is None:
        return out
    last = reports.groupBy("name").agg(F.max_by(F.struct(*[c for c in reports.columns if c != "name"]), "ts").alias("report"))
    return out.join(last, "name", "left")


def commit_schema() -> T.StructType:
    """What a version's file holds: the registry row, what it was trained after and on."""
    return T.StructType([*log_schema("models").fields, T.StructField("parent", T.StringType()), T.StructField("batches", T.ArrayType(T.StringType()))])


def new_id() -> int:
    """Rising with time, and not shared by writers of the same microsecond."""
    return (time.time_ns() // 1000 << 10) + random.SystemRandom().randrange(1 << 10)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole file, unless there is one of that name already: of several writers, one succeeds.

    On a local disk the finished file is linked to its name; elsewhere it is
    renamed, which file systems such as HDFS refuse where the name is taken. A
    store without such a rename needs one writer at a time.
    """
    jvm = spark._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(target) and fs.rename(draft, target)
        local = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
        try:
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)


def with_newer(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Old and new rows; where both have an id, the new row."""
    return old.join(new.select(id_col), id_col, "left_anti").select(old.columns).unionByName(new, allowMissingColumns=True)


class ModelStore:
    """Save, look up, load and delete models below one folder.

    A version is one file that is put in place whole and only if its number is
    free; whoever finds it taken goes on with the next. So two writers at once
    get two versions, and a version is never there by half.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def versions(self) -> DataFrame:
        """Every committed version, deleted ones too, with its parent and the batches of rows it was trained on."""
        path = f"{self.root}/versions"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], commit_schema())
        return self.spark.read.schema(commit_schema()).option("pathGlobFilter", "v*.json").option("recursiveFileLookup", "true").json(path)

    def models(self) -> DataFrame:
        rows = self.versions().select(log_schema("models").fieldNames())
        return live_models(rows, read_log(self.spark, self.root, "tombstones"))

    def save(self, model: PipelineModel, name: str, model_type: str, metrics: dict[str, float] | None = None,
             hyperparameters: dict[str, str] | None = None, importance: dict[str, float] | None = None,
             now: dt.datetime | None = None, rows: DataFrame | None = None, parent: str | None = None) -> int:
        """Write the model as the next version of its name and return its id.

        ``rows`` are kept with it as a batch of training rows, behind the
        batches of ``parent``, an earlier version of the name.
        """
        now = now or dt.datetime.now()
        model_id = new_id()
        folder = f"{self.root}/files/{quote(name, safe='')}/{model_id}"
        model.write().save(f"{folder}/model")
        batches = list(self.version(name, parent)["batches"] or []) if parent else []
        if rows is not None:
            rows.write.parquet(f"{folder}/rows")
            batches.append(f"{folder}/rows")
        commit = {
            "id": model_id, "name": name, "model_type": model_type, "created_at": now.isoformat(), "updated_at": now.isoformat(),
            "hyperparameters": {k: str(v) for k, v in (hyperparameters or {}).items()},
            "metrics": {k: float(v) for k, v in (metrics or {}).items() if v is not None},
            "feature_importance": {k: float(v) for k, v in (importance or {}).items()},
            "path": f"{folder}/model", "preprocessing": {}, "parent": parent, "batches": batches,
        }
        # Deleted versions keep their number, so it is never given twice.
        taken = self.versions().where(F.col("name") == name).agg(F.max(version_number())).first()[0] or 0
        while True:
            taken += 1
            text = json.dumps({**commit, "version": f"v{taken}"})
            if put_if_absent(self.spark, f"{self.root}/versions/{quote(name, safe='')}/v{taken}.json", text):
                break
        self.log_training(model_id, "saved", {"version": f"v{taken}"}, now)
        return model_id

    def version(self, name: str, version: str):
        """The commit of one version of a name."""
        row = self.versions().where((F.col("name") == name) & (F.col("version") == version)).first()
        if row is None:
            raise KeyError(f"no version {version} of {name}")
        return row

    def latest(self, name: str):
        """The commit of the latest version that was not deleted, or nothing."""
        gone = read_log(self.spark, self.root, "tombstones")
        return live_models(self.versions().where(F.col("name") == name), gone).orderBy(version_number().desc()).first()

    def training_rows(self, name: str, version: str, id_col: str) -> DataFrame | None:
        """All rows a version was trained on: of rows with one id, that of the newest batch."""
        rows = None
        for path in self.version(name, version)["batches"] or []:
            batch = self.spark.read.parquet(path)
            rows = batch if rows is None else with_newer(rows, batch, id_col)
        return rows

    def find(self, name_or_id: str | int):
        """The registry row of an id, or of the latest version of a name."""
        models = self.models()
        if isinstance(name_or_id, int):
            row = models.where(F.col("id") == name_or_id).first()
        else:
            row = models.where(F.col("name") == name_or_id).orderBy(version_number().desc()).first()
        if row is None:
            raise KeyError(f"no model {name_or_id}")
        return row

    def load(self, name_or_path: str | int) -> PipelineModel:
        """By id, by name (its latest version), or straight from a saved path."""
        if isinstance(name_or_path, str) and "/" in name_or_path:
            return PipelineModel.load(name_or_path)
        return PipelineModel.load(self.find(name_or_path)["path"])

    def delete(self, name_or_id: str | int, now: dt.datetime | None = None) -> None:
        """Mark a model as deleted; its rows and files stay."""
        row = (self.find(name_or_id)["id"], now or dt.datetime.now())
        append_log(self.spark.createDataFrame([row], log_schema("tombstones")), self.root, "tombstones")

    def log_training(self, model_id: int, event: str, details: dict[str, str], now: dt.datetime | None = None) -> None:
        row = (new_id(), model_id, now or dt.datetime.now(), event, details)
        append_log(self.spark.createDataFrame([row], log_schema("training_logs")), self.root, "training_logs")
