"""Running sums and row numbers over a global order, without one big task.

A window over a whole table (or over a group that holds a third of it) sorts
everything in one task. Here the order is cut into buckets first: the window
runs inside a bucket, and the sum of all earlier buckets is added. Buckets are
a pure function of the ordered value, so a retried task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bucket_count, cut, join_lookup

BUCKET = "_bucket"
KEY = "_key"


def add_value_buckets(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Cut a numeric column into about ``buckets`` equal-sized ranges.

    The bounds come from a quantile sketch of the whole column, so no range
    holds much more than its share of the rows, whichever group they are in.
    """
    probs = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.approxQuantile(value, probs, 1.0 / (4 * buckets)))) if probs else []
    cutter = Bucketizer(
        splits=[float("-inf"), *bounds, float("inf")], inputCol=value, outputCol=BUCKET
    ) if bounds else None
    if cutter is None:
        return df.withColumn(BUCKET, F.lit(0.0))
    # Missing values come first in every order used here.
    return cutter.transform(df).withColumn(BUCKET, F.coalesce(BUCKET, F.lit(-1.0)))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Sequence[str],
    bucket: str | None = None,
) -> DataFrame:
    """Add ``upto_<s>`` and ``total_<s>`` for every column in ``sums``.

    ``upto_`` counts the row itself and all rows before it within ``keys``.
    With ``bucket`` (a column that never falls along ``order``) the work is
    split by it; without, the window runs per key and the caller vouches that
    no key is large.
    """
    columns = df.columns
    if bucket:
        # As one struct, a key with nulls still meets itself in the join below.
        df = df.withColumn(KEY, F.struct(*keys))
    cells = [KEY, bucket] if bucket else list(keys)
    upto = W.partitionBy(*cells).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = df.select("*", *[F.sum(s).over(upto).alias(f"upto_{s}") for s in sums])
    if not bucket:
        whole = W.partitionBy(*keys)
        return local.select("*", *[F.sum(s).over(whole).alias(f"total_{s}") for s in sums])

    # One row per key and bucket: the window below sees at most that many.
    totals = df.groupBy(*cells).agg(*[F.sum(s).alias(f"cell_{s}") for s in sums])
    earlier = W.partitionBy(KEY).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *cells,
        *[F.coalesce(F.sum(f"cell_{s}").over(earlier), F.lit(0)).alias(f"off_{s}") for s in sums],
        *[F.sum(f"cell_{s}").over(W.partitionBy(KEY)).alias(f"total_{s}") for s in sums],
    )
    joined = local.join(offsets, cells)
    return joined.select(
        *columns,
        *[(F.col(f"upto_{s}") + F.col(f"off_{s}")).alias(f"upto_{s}") for s in sums],
        *[f"total_{s}" for s in sums],
    )


def running_by_value(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Sequence[str],
    buckets: int | None = None,
) -> DataFrame:
    """``running`` along a numeric column, one row per keys and value.

    The rows are written once and counted; they are then sketched and bucketed,
    unless they were found to fit one bucket.
    """
    held = cut(df)
    buckets = bucket_count(held.count()) if buckets is None else buckets
    if buckets <= 1:
        return running(held, keys, [F.col(value)], sums)
    bucketed = add_value_buckets(held, value, buckets)
    return running(bucketed, keys, [F.col(value)], sums, bucket=BUCKET).drop(BUCKET)


def number_by_time(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, newest_first: bool = False, buckets: int | None = None
) -> DataFrame:
    """Add ``position``, 1.. in time order within keys, over time ranges of equal size."""
    seconds = F.col(ts).cast("timestamp").cast("double")
    timed = df.withColumn("_t", -seconds if newest_first else seconds).withColumn("_one", F.lit(1).cast("long"))
    order = [F.col("_t"), F.desc(tie) if newest_first else F.col(tie)]
    held = cut(timed)
    buckets = bucket_count(held.count()) if buckets is None else buckets
    if buckets <= 1:
        out = running(held, keys, order, ["_one"])
    else:
        out = running(add_value_buckets(held, "_t", buckets), keys, order, ["_one"], bucket=BUCKET)
    return out.select(*df.columns, F.col("upto__one").alias("position"))


def hash_order(*columns: str | Column, seed: int = 42) -> Column:
    """A repeatable shuffle key: the MD5 hex of the columns and a seed."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def _hash_range() -> Column:
    """The leading hex digits that cut the hash into 65536 ranges."""
    return F.substring("_h", 1, 4)


def number_by_hash(df: DataFrame, keys: Sequence[str], id_col: str, seed: int = 42) -> DataFrame:
    """Add ``position`` (1..n within keys, in hash order) and ``group_size``.

    The first hex digits of the hash cut every key into equal ranges, so a hot
    key is spread over as many tasks. A row takes the 16 bytes of its hash along
    when it is moved, and an id that is a text or a whole number only if the
    caller goes on with it.
    """
    tagged = df.withColumn("_h", hash_order(id_col, seed=seed)).withColumn("_one", F.lit(1).cast("long"))
    # The bytes sort as their hex digits do.
    tagged = tagged.withColumn(BUCKET, _hash_range()).withColumn("_h", F.unhex("_h"))
    # Texts or whole numbers of one hash are equal; others may only look alike as texts.
    told_apart = isinstance(df.select(id_col).schema[0].dataType, (T.StringType, T.IntegralType))
    order = [F.col("_h")] if told_apart else [F.col("_h"), F.col(id_col)]
    out = running(tagged, keys, order, ["_one"], bucket=BUCKET)
    return out.withColumnsRenamed({"upto__one": "position", "total__one": "group_size"}).drop("_h", "_one", BUCKET)


def first_by_hash(df: DataFrame, keys: Sequence[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of every key in hash order, without moving the table.

    Rows are counted by key and hash range. Ranges that fit whole are kept by a
    filter; only the rows of the one range where the n-th row falls are ranked.
    """
    tagged = df.withColumns({"_h": hash_order(id_col, seed=seed), KEY: F.struct(*keys)})
    tagged = tagged.withColumn(BUCKET, _hash_range())
    # One row per key and range.
    cells = tagged.groupBy(KEY, BUCKET).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(KEY).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = cells.select(KEY, BUCKET, "_n", upto.alias("_upto")).where(F.col("_upto") - F.col("_n") < n)
    edge = ends.groupBy(KEY).agg(
        F.max(BUCKET).alias("_last"), F.max_by(F.lit(n) - (F.col("_upto") - F.col("_n")), BUCKET).alias("_left")
    )
    marked = join_lookup(tagged, edge, [KEY])
    whole = marked.where(F.col(BUCKET) < F.col("_last"))
    place = F.row_number().over(W.partitionBy(KEY).orderBy("_h", id_col))
    part = marked.where(F.col(BUCKET) == F.col("_last")).withColumn("_p", place).where(F.col("_p") <= F.col("_left"))
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """``column``, code: distinct values numbered 0.. in sorted order.

    Any sortable type. The values are range-sorted over all tasks and written; a
    value's number is its place in its partition plus the sizes of the
    partitions before it.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    placed = cut(values.orderBy(column).select(column, F.monotonically_increasing_id().alias("_place")))
    part = F.shiftright(F.col("_place"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the sorted table.
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(column, (within + F.col("_start")).alias("code"))
    )
