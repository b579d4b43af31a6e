"""Cutting lineage, and counts made before a plan is chosen."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Aimed-at rows of one ordered bucket.
BUCKET_ROWS = 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The folder named by ``spark.checkpoint.dir`` is used. Only a local
    session without that setting gets a temporary folder; on a cluster a
    machine-local folder would be lost with its executor, so it is refused.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and go on from it: what a model keeps, or a loop repeats."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, parts: int = 64) -> DataFrame:
    """Deal a table over ``parts`` tasks, before work that is heavy per row on a table read by few tasks.

    The number is the caller's: what a model learns must not hang on the cores
    of a cluster or on a guess of the table's size.
    """
    return df.repartition(parts)


def bucket_count(rows: int) -> int:
    """How many ordered buckets keep each one near ``BUCKET_ROWS`` of a table whose rows were counted."""
    return -(-rows // BUCKET_ROWS) or 1


# A lookup counted to hold at most this many rows is broadcast.
LOOKUP_ROWS = 100_000


def join_lookup(
    df: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", most_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """Join a table that is usually small, without trusting that it is.

    The lookup is read up to ``most_rows``. If it ends there, those rows are
    broadcast; otherwise both sides are shuffled and adaptive execution splits
    skewed keys.
    """
    rows = lookup.limit(most_rows + 1).collect()
    if len(rows) <= most_rows:
        small = df.sparkSession.createDataFrame(rows, lookup.schema)
        return df.join(F.broadcast(small), on, how)
    return df.join(lookup, on, how)
