"""Table profiling: every function returns a small DataFrame, one row per fact."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    PASS_WIDTH,
    as_double,
    doubles,
    long_numbers,
    long_text,
    named,
    numbered,
    numeric_columns,
    per_column,
    present,
    safe_divide,
    text_columns,
    union_all,
)
from ..functions.ordered import hash_order
from ..functions.quantiles import quantiles

QUARTILES = (0.25, 0.5, 0.75)


def dataset_info(df: DataFrame) -> DataFrame:
    """kind, n: row count, column count and one row per data type."""
    types: dict[str, int] = {}
    for field in df.schema.fields:
        types[field.dataType.simpleString()] = types.get(field.dataType.simpleString(), 0) + 1
    facts = [("columns", len(df.columns)), *[(f"type {t}", n) for t, n in sorted(types.items())]]
    rows = df.agg(F.count("*").alias("n"))
    pairs = F.array(
        F.struct(F.lit("rows").alias("kind"), F.col("n").alias("n")),
        *[F.struct(F.lit(k).alias("kind"), F.lit(n).cast("long").alias("n")) for k, n in facts],
    )
    return rows.select(F.inline(pairs))


def _moments(df: DataFrame, columns: Sequence[str], shape: bool = False) -> DataFrame:
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    if shape:
        measures |= {"g1": F.skewness, "g2": F.kurtosis}
    return per_column(doubles(df, columns), columns, measures)


def _with_quartiles(moments: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = quantiles(df, columns, QUARTILES).select(
        "feature", *[F.col("q")[i].alias(f"q{int(p * 100)}") for i, p in enumerate(QUARTILES)]
    )
    return moments.join(found, "feature")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric column."""
    columns = numeric_columns(df) if columns is None else columns
    out = _with_quartiles(_moments(df, columns), df, columns)
    return out.select("feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mean, median, std, min, max, skew and kurtosis.

    Skew and kurtosis carry the sample bias adjustment; they are 0 for a
    constant column and null below 3 and 4 values.
    """
    columns = numeric_columns(df) if columns is None else columns
    n = F.col("count").cast("double")
    flat = F.col("std") == 0
    skew = safe_divide(F.col("g1") * F.sqrt(n * (n - 1)), n - 2)
    kurt = safe_divide(((n + 1) * F.col("g2") + 6) * (n - 1), (n - 2) * (n - 3))
    out = _with_quartiles(_moments(df, columns, shape=True), df, columns)
    return out.select(
        "feature",
        "mean",
        F.col("q50").alias("median"),
        "std",
        "min",
        "max",
        F.when(n >= 3, F.when(flat, F.lit(0.0)).otherwise(skew)).alias("skew"),
        F.when(n >= 4, F.when(flat, F.lit(0.0)).otherwise(kurt)).alias("kurtosis"),
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, rows, missing, missing_pct for all columns."""
    columns = df.columns if columns is None else columns
    counts = per_column(
        df,
        columns,
        {"rows": lambda c: F.count("*"), "missing": lambda c: F.count_if(present(df, c).isNull())},
    )
    pct = F.round(safe_divide(F.col("missing") * 100, F.col("rows")), 2)
    return counts.select("*", F.coalesce(pct, F.lit(0.0)).alias("missing_pct"))


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values, the worst first."""
    return null_counts(df).where("missing > 0").orderBy(F.desc("missing_pct"), "feature")


def missing_total(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(
        F.sum("missing").alias("total_missing"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
    )


def _digest(df: DataFrame, name: str) -> Column:
    """Two hashes of a value, together wide enough to stand for it; null where it is missing."""
    value = present(df, name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        # Zero has no sign.
        value = value + F.lit(0.0)
    return F.when(value.isNotNull(), F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(name), value).alias("b")))


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, rows, missing, distinct of every column, from one narrow pass.

    A cell is its column's number and a digest of its value. Cells are counted
    by value before they are shuffled, so a value that fills a column costs one
    row per task, and no row is copied whole per column. Missing values are not
    counted as a value.
    """
    columns = df.columns if columns is None else list(columns)
    parts = []
    for start in range(0, len(columns), PASS_WIDTH):
        chunk = columns[start : start + PASS_WIDTH]
        cells = df.select(F.inline(F.array(*[F.struct(F.lit(start + i).alias("feature"), _digest(df, c).alias("h")) for i, c in enumerate(chunk)])))
        values = cells.groupBy("feature", F.col("h.a").alias("a"), F.col("h.b").alias("b")).agg(F.count("*").alias("n"))
        parts.append(values.groupBy("feature").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("a").isNull(), F.col("n"))).alias("missing"), F.count("a").alias("distinct")))
    # An empty table has columns all the same.
    names = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("feature"))
    full = names.join(union_all(parts), "feature", "left") if parts else names.select("feature", *[F.lit(None).cast("long").alias(c) for c in ("rows", "missing", "distinct")])
    filled = full.select("feature", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "missing", "distinct")])
    return named(filled, columns)


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """feature, distinct: nulls are not counted.

    ``approximate`` estimates from sketches in one pass without a shuffle of
    values (see ``sketches`` for those that can be kept and merged).
    """
    columns = df.columns if columns is None else columns
    if approximate:
        return per_column(df, columns, {"distinct": lambda c: F.approx_count_distinct(present(df, c))})
    return column_facts(df, columns).select("feature", "distinct")


def column_overview(df: DataFrame) -> DataFrame:
    """feature, type, distinct, missing_pct in column order, from one pass."""
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    places = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    pct = F.coalesce(F.round(safe_divide(F.col("missing") * 100, F.col("rows")), 2), F.lit(0.0))
    return (
        column_facts(df)
        .select("feature", kinds[F.col("feature")].alias("type"), "distinct", pct.alias("missing_pct"))
        .orderBy(places[F.col("feature")])
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n: most frequent first, nulls left out."""
    return (
        df.select(present(df, column).alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def value_shares(df: DataFrame, column: str, of_all_rows: bool = False) -> DataFrame:
    """value, n, share: of the non-null rows, or of all rows."""
    counts = df.groupBy(present(df, column).alias("value")).agg(F.count("*").alias("n"))
    if not of_all_rows:
        counts = counts.where(F.col("value").isNotNull())
    # The total is summed by a plain aggregate, as the values may be many.
    total = counts.agg(F.sum("n").alias("t"))
    share = safe_divide(F.col("n"), total.scalar())
    return counts.where(F.col("value").isNotNull()).select("value", "n", share.alias("share"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """feature, value, n, place: the k most frequent values per text column.

    The rank filter is pushed below the shuffle by the optimizer, so each task
    sends k rows per column.
    """
    columns = text_columns(df) if columns is None else columns
    counts = (
        long_text(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"))
    )
    place = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("n"), "value"))
    return named(counts.withColumn("place", place).where(F.col("place") <= k), columns)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, duplicates: copies after the first occurrence."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def fences(df: DataFrame, columns: Sequence[str], threshold: float = 1.5) -> DataFrame:
    """feature, q25, q75, lower_bound, upper_bound."""
    found = quantiles(df, columns, (0.25, 0.75)).select(
        "feature", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75")
    )
    spread = F.col("q75") - F.col("q25")
    return found.select(
        "*",
        (F.col("q25") - threshold * spread).alias("lower_bound"),
        (F.col("q75") + threshold * spread).alias("upper_bound"),
    )


def fence_map(df: DataFrame, columns: Sequence[str], threshold: float = 1.5) -> dict[str, tuple]:
    """The fences as numbers, one pair per column, to be used as literals."""
    return {
        r["feature"]: (r["lower_bound"], r["upper_bound"]) for r in fences(df, columns, threshold).collect()
    }


def outside(df: DataFrame, column: str, bounds: tuple) -> Column:
    """True where the value is strictly outside the bounds."""
    if bounds[0] is None:
        return F.lit(False)
    x = as_double(df, column)
    return F.coalesce((x < bounds[0]) | (x > bounds[1]), F.lit(False))


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.5) -> DataFrame:
    """feature, rows, outliers, lower_bound, upper_bound."""
    columns = numeric_columns(df) if columns is None else columns
    bounds = fence_map(df, columns, threshold)
    return per_column(
        df,
        columns,
        {
            "rows": lambda c: F.count("*"),
            "outliers": lambda c: F.count_if(outside(df, c, bounds[c])),
            "lower_bound": lambda c: F.max(F.lit(bounds[c][0]).cast("double")),
            "upper_bound": lambda c: F.max(F.lit(bounds[c][1]).cast("double")),
        },
    )


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.5) -> DataFrame:
    """``describe`` with outlier count and bounds: quartiles first, then all else in one pass with them as literals."""
    columns = numeric_columns(df) if columns is None else columns
    slim = doubles(df, columns)
    quartiles = {r["feature"]: r["q"] for r in quantiles(slim, columns, QUARTILES).collect()}

    def bound(c: str, side: int):
        q1, _, q3 = quartiles[c]
        return None if q1 is None else (q1, q3)[side > 0] + side * threshold * (q3 - q1)

    known = lambda value: F.max(F.lit(value).cast("double"))
    return per_column(
        slim,
        columns,
        {
            "count": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": F.min,
            **{f"q{int(p * 100)}": lambda c, i=i: known(quartiles[c][i]) for i, p in enumerate(QUARTILES)},
            "max": F.max,
            "outliers": lambda c: F.count_if(outside(slim, c, (bound(c, -1), bound(c, 1)))),
            "lower_bound": lambda c: known(bound(c, -1)),
            "upper_bound": lambda c: known(bound(c, 1)),
        },
    )


def outlier_rows(df: DataFrame, column: str, threshold: float = 1.5) -> DataFrame:
    return df.where(outside(df, column, fence_map(df, [column], threshold)[column]))


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """fact, value: five statistics of a number, or distinct count and balance of a text."""
    if target in numeric_columns(df, with_bool=True):
        x = as_double(df, target)
        row = df.agg(
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        )
        median = quantiles(df, [target], [0.5]).select(F.lit("median").alias("fact"), F.col("q")[0].alias("value"))
        return row.unpivot([], ["mean", "std", "min", "max"], "fact", "value").unionByName(median)
    shares = value_shares(df, target, of_all_rows=True)
    balance = shares.select(F.concat(F.lit("share "), "value").alias("fact"), F.col("share").alias("value"))
    counts = shares.select(F.concat(F.lit("count "), "value").alias("fact"), F.col("n").cast("double").alias("value"))
    distinct = df.agg(F.count_distinct(target).cast("double").alias("value")).select(F.lit("distinct").alias("fact"), "value")
    return distinct.unionByName(counts).unionByName(balance)


def correlations(df: DataFrame, columns: Sequence[str] | None = None, wide: bool | None = None) -> DataFrame:
    """a, b, r for every pair a before b: Pearson over the rows where both are present.

    A constant column gives null. Few columns are aggregated pair by pair. With
    many (``wide``, by default above the width of one pass) the pairs would take
    a read for every few columns; sums of products of all are then taken in one.
    """
    columns = numeric_columns(df) if columns is None else columns
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if wide or (wide is None and len(pairs) > 2 * PASS_WIDTH):
        return wide_correlations(df, columns)
    df = doubles(df, columns)
    exprs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a), F.col(b)
        both_x, both_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        spread = F.stddev_samp(both_x) * F.stddev_samp(both_y)
        r = safe_divide(F.covar_samp(both_x, both_y), spread)
        exprs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")).alias(f"p_{i}"))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    row = df.agg(*exprs)
    return row.select(F.inline(F.array(*[F.col(f"p_{i}") for i in range(len(pairs))])))


#: Columns of one block of sums, and rows that are multiplied at once.
GRAM_BLOCK, GRAM_ROWS = 64, 4096


def wide_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``correlations`` of any number of columns in one read of the table.

    A task multiplies its rows as matrices: values, squares and marks of
    presence give, for every pair, the six sums over the rows where both are
    present. Sums leave a task once, in blocks, and are added up by Spark.
    Values are taken relative to one that occurs, so that a large mean does not
    swallow the differences.
    """
    columns = list(columns)
    k = len(columns)
    slim = doubles(df, columns)
    some = slim.limit(100).collect()
    origin = np.array([next((r[i] for r in some if r[i] is not None), 0.0) for i in range(k)])
    rows = slim.select(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(float("nan"))) for c in columns]).alias("x"))

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            column = batch.column(0)
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            for start in range(0, len(values), GRAM_ROWS):
                x = values[start : start + GRAM_ROWS] - origin
                there = (~np.isnan(x)).astype("float64")
                x = np.where(there > 0, x, 0.0)
                square = x * x
                part = np.stack([there.T @ there, x.T @ there, square.T @ there, x.T @ x])
                total = part if total is None else total + part
        if total is None:
            return
        # For row i and column j: how many, sums and squares of either where both are, products.
        whole = np.stack([total[0], total[1], total[1].T, total[2], total[2].T, total[3]])
        for low in range(0, k, GRAM_BLOCK):
            high = min(k, low + GRAM_BLOCK)
            # Only pairs above the diagonal are asked for.
            at = np.arange(min(high, k))
            flat = whole[:, : len(at), low:high].transpose(1, 0, 2).reshape(len(at), -1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), low, np.int32)), values], ["i", "low", "v"])

    parts = rows.mapInArrow(sums, "i int, low int, v array<double>")
    added = parts.groupBy("i", "low").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("i", "low", vector_to_array("v").alias("v"))
    width = (F.size("v") / 6).cast("int")
    cell = lambda s, j: F.get("v", s * F.col("_w") + j)
    sums_of = lambda j: F.struct((F.col("low") + j).alias("j"), *[cell(s, j).alias(n) for s, n in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))])
    pairs = added.withColumn("_w", width).select("i", F.inline(F.transform(F.sequence(F.lit(0), F.col("_w") - 1), sums_of))).where("i < j")

    def variance(square: str, total: str) -> Column:
        v = F.col(square) - F.col(total) * F.col(total) / F.col("n")
        # What rounding leaves of a constant is no variance.
        return F.when(v > F.col(square) * 1e-13, v)

    over = F.sqrt(variance("sxx", "sx")) * F.sqrt(variance("syy", "sy"))
    r = F.when(F.col("n") > 1, safe_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), over))
    names = F.array(*map(F.lit, columns))
    return pairs.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), r.alias("r"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Both halves and the diagonal, in long form."""
    columns = numeric_columns(df) if columns is None else columns
    half = correlations(df, columns)
    other = half.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    spread = per_column(df, columns, {"std": lambda c: F.stddev_samp(as_double(df, c))})
    own = spread.select(F.col("feature").alias("a"), F.col("feature").alias("b"), F.when(F.col("std") > 0, 1.0).alias("r"))
    return half.unionByName(other).unionByName(own)


def strongest_correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return correlations(df, columns).orderBy(F.desc_nulls_last(F.abs("r")), "a", "b")


def high_correlations(df: DataFrame, threshold: float = 0.8, columns: Sequence[str] | None = None) -> DataFrame:
    return correlations(df, columns).select("a", "b", F.abs("r").alias("r")).where(F.col("r") > threshold)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """feature, bin, low, high, n: equal-width bins, the last edge inclusive, empty bins left out."""
    edges = per_column(doubles(df, columns), columns, {"lo": F.min, "hi": F.max})
    return named(bin_counts(long_numbers(df, columns), numbered(edges, columns), bins), columns)


def bin_counts(cells: DataFrame, edges: DataFrame, bins: int, keep: Sequence[str] = ()) -> DataFrame:
    """Count feature/value cells by the equal-width bins of ``edges`` (feature, lo, hi).

    A column with one value is binned over that value plus and minus a half.
    """
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(
        "feature",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width)).cast("int")
    # One row per column: bounded by the schema.
    counted = (
        cells.where(F.col("value").isNotNull())
        .join(F.broadcast(edges), "feature")
        .groupBy(*keep, "feature", "lo", "hi", place.alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    return counted.select(
        *keep, "feature", "bin", (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n",
    )


def box_summary(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.5) -> DataFrame:
    """feature, low_whisker, q25, median, q75, high_whisker: whiskers are the last values inside the fences."""
    columns = numeric_columns(df) if columns is None else columns
    five = quantiles(df, columns, QUARTILES)
    found = {r["feature"]: r["q"] for r in five.collect()}

    def inside(c: str) -> Column:
        q1, _, q3 = found[c]
        x = as_double(df, c)
        if q1 is None:
            return F.lit(None).cast("double")
        return F.when((x >= q1 - threshold * (q3 - q1)) & (x <= q3 + threshold * (q3 - q1)), x)

    literal = lambda c, i: F.max(F.lit(found[c][i]).cast("double"))
    return per_column(
        df,
        columns,
        {
            "low_whisker": lambda c: F.min(inside(c)),
            "q25": lambda c: literal(c, 0),
            "median": lambda c: literal(c, 1),
            "q75": lambda c: literal(c, 2),
            "high_whisker": lambda c: F.max(inside(c)),
        },
    )


def missing_pattern_sample(df: DataFrame, id_col: str, n: int = 100, seed: int = 42) -> DataFrame:
    """Null flags (0/1) of n rows picked in hash order of the id: a top-n, not a sort."""
    flags = [present(df, c).isNull().cast("int").alias(c) for c in df.columns if c != id_col]
    return df.orderBy(hash_order(id_col, seed=seed), id_col).limit(n).select(id_col, *flags)


def row_sample(df: DataFrame, id_col: str, columns: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """n rows in hash order of the id, for scatter views of two or more columns."""
    return df.orderBy(hash_order(id_col, seed=seed), id_col).limit(n).select(id_col, *columns)


def simple_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mean, population std, min, max per column."""
    columns = numeric_columns(df) if columns is None else columns
    measures = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return per_column(doubles(df, columns), columns, measures)


def feature_insight(df: DataFrame, column: str) -> DataFrame:
    """One row: missing count and percent, distinct values, outliers of one column."""
    bounds = fence_map(df, [column])[column] if column in numeric_columns(df) else (None, None)
    missing = F.count_if(present(df, column).isNull())
    return df.agg(
        F.lit(column).alias("feature"),
        missing.alias("missing"),
        F.round(safe_divide(missing * 100, F.count("*")), 2).alias("missing_pct"),
        F.count_distinct(present(df, column)).alias("distinct"),
        F.count_if(outside(df, column, bounds)).alias("outliers"),
    )


def group_shares(df: DataFrame, column: str) -> DataFrame:
    """value, n, pct: size and share of every group, for example clusters."""
    shares = value_shares(df, column)
    return shares.select("value", "n", F.round(F.col("share") * 100, 1).alias("pct"))


def importance_matrix(importances: DataFrame, models: Sequence[str]) -> DataFrame:
    """model, feature, importance -> one row per feature, one column per model."""
    return importances.groupBy("feature").pivot("model", list(models)).agg(F.first("importance"))
