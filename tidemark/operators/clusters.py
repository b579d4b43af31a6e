"""Quality of clusterings and of dimension reductions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_divide
from ..functions.ordered import hash_order, running_by_value
from ..functions.scratch import join_lookup, written
from .pairs import BLOCK_ROWS, block_pairs, distance_sums, distances, matrix, vectors
from .profile import group_shares


def cluster_sizes(df: DataFrame, cluster: str = "prediction") -> DataFrame:
    """value, n, pct."""
    return group_shares(df, cluster)


def centroids(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """cluster, n, center array, within: squared distances of the members to the center, summed."""
    x = [F.col(c).cast("double") for c in features]
    inner = sum((F.var_pop(c) for c in x[1:]), F.var_pop(x[0]))
    return df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("center"), (F.count("*") * inner).alias("within")
    )


def _square_gap(a, b):
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def _calinski_harabasz(found: DataFrame, k: int) -> DataFrame:
    """n_clusters, calinski_harabasz from the ``centroids`` of ``k`` features."""
    mean = F.array(*[F.sum(F.col("n") * F.col("center")[i]) / F.sum("n") for i in range(k)])
    overall = found.agg(mean.alias("m")).first()["m"] or []
    between = F.sum(F.col("n") * _square_gap(F.col("center"), F.array(*map(F.lit, overall))))
    groups = F.count("*")
    score = safe_divide(between * (F.sum("n") - groups), F.sum("within") * (groups - 1))
    return found.agg(groups.alias("n_clusters"), F.when(groups > 1, score).alias("calinski_harabasz"))


def calinski_harabasz(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """n_clusters, calinski_harabasz, from one pass over the rows."""
    return _calinski_harabasz(written(centroids(df, features, cluster), "centroids"), len(features))


#: Numbers of all cluster centres together that every task may hold at once.
HELD_NUMBERS = 1_000_000


def squared_silhouette(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """silhouette by squared distance, over all rows, without comparing rows.

    The mean squared distance from a row to a cluster follows from the
    cluster's centre and spread: the squared distance to the centre plus the
    mean squared distance of the members to it. So one pass makes a row per
    cluster, and one more measures every row against those. Rows alone in their
    cluster count 0; with one cluster the result is null.
    """
    return _squared_silhouette(df, features, cluster, written(centroids(df, features, cluster), "centroids"))


def _squared_silhouette(df: DataFrame, features: Sequence[str], cluster: str, found: DataFrame) -> DataFrame:
    groups = found.count()
    rows = df.select(F.col(cluster).alias("own"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    spread = (F.col("within") / F.col("n")).alias("s")
    if groups * len(features) <= HELD_NUMBERS:
        # Counted to be few: all clusters as one row.
        all_of_them = found.select(F.struct("cluster", "n", "center", spread).alias("c")).agg(F.collect_list("c").alias("cs"))
        each = rows.join(F.broadcast(all_of_them))
        distance = lambda c: _square_gap(F.col("x"), c["center"]) + c["s"]
        mine = lambda c: c["cluster"].eqNullSafe(F.col("own"))
        own = F.filter("cs", mine)[0]
        sides = each.select(
            F.when(own["n"] > 1, distance(own) * own["n"] / (own["n"] - 1)).alias("a"),
            F.array_min(F.transform(F.filter("cs", lambda c: ~mine(c)), distance)).alias("b"),
        )
    else:
        sides = _sides_by_blocks(rows, found.select("cluster", "n", "center", spread))
    score = safe_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return sides.where("b IS NOT NULL").agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("silhouette"))


def _sides_by_blocks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """a, b of ``_squared_silhouette`` with more centres than a task should hold: a block of rows meets a block of centres."""
    numbered = written(rows.withColumn("id", F.monotonically_increasing_id()), "rows")
    names = F.to_json(F.struct(F.col("cluster").alias("c")))
    centres = found.withColumn("name", names).withColumn("id", F.xxhash64("name")).drop("cluster")
    asked = numbered.select("id", "x", F.to_json(F.struct(F.col("own").alias("c"))).alias("name"))

    def reduce(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        d = distances(matrix(left["x"]), matrix(right["center"])) ** 2 + right["s"].to_numpy()[None, :]
        same = left["name"].to_numpy()[:, None] == right["name"].to_numpy()[None, :]
        n = right["n"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(same & (n > 1), d * n / (n - 1), -1.0).max(axis=1)
        other = np.where(same, np.inf, d).min(axis=1)
        return pd.DataFrame({"id": left["id"].to_numpy(), "a": own, "b": other})

    parts = block_pairs(asked, centres, "id", reduce, "id long, a double, b double")
    best = parts.groupBy("id").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    return best.select(F.when(F.col("a") >= 0, F.col("a")).alias("a"), F.when(F.col("b") < float("inf"), F.col("b")).alias("b"))


def davies_bouldin(df: DataFrame, features: Sequence[str], cluster: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """davies_bouldin: mean over clusters of the worst ratio of spread to centre distance."""
    return _davies_bouldin(df, features, cluster, centroids(df, features, cluster), block_rows)


def _davies_bouldin(df: DataFrame, features: Sequence[str], cluster: str, centres: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    found = centres.select("cluster", "center")
    rows = vectors(df, cluster, features).withColumnRenamed(cluster, "cluster")
    gap = F.sqrt(_square_gap(F.col("features"), F.col("center")))
    spread = join_lookup(rows, found, ["cluster"]).groupBy("cluster").agg(F.avg(gap).alias("spread"), F.first("center").alias("features"))

    def reduce(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = distances(matrix(a["features"]), matrix(b["features"]))
        same = a["cluster"].to_numpy()[:, None] == b["cluster"].to_numpy()[None, :]
        total = a["spread"].to_numpy()[:, None] + b["spread"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(same, -1.0, total / d)
        return pd.DataFrame({"cluster": a["cluster"].to_numpy(), "worst": ratio.max(axis=1)})

    worst = block_pairs(spread, spread, "cluster", reduce, "cluster long, worst double", block_rows)
    return worst.groupBy("cluster").agg(F.max("worst").alias("w")).where("w >= 0").agg(F.avg("w").alias("davies_bouldin"))


def silhouette(df: DataFrame, key: str, features: Sequence[str] | str, cluster: str,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """silhouette by euclidean distance, over all rows; rows alone in their cluster count 0."""
    rows = vectors(df, key, features, [F.col(cluster).cast("long").alias("cluster")])

    def reduce(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        groups, place = np.unique(b["cluster"].to_numpy(), return_inverse=True)
        member = np.zeros((len(b), len(groups)))
        member[np.arange(len(b)), place] = 1.0
        return pd.DataFrame(
            {
                "key": np.repeat(a[key].to_numpy(), len(groups)),
                "own": np.repeat(a["cluster"].to_numpy(), len(groups)),
                "cluster": np.tile(groups, len(a)),
                "total": distance_sums(matrix(a["features"]), matrix(b["features"]), member).ravel(),
                "n": np.tile(member.sum(axis=0), len(a)),
            }
        )

    schema = "key long, own long, cluster long, total double, n double"
    sums = block_pairs(rows, rows, key, reduce, schema, block_rows, wide=True)
    per = sums.groupBy("key", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mine = F.col("own") == F.col("cluster")
    sides = per.groupBy("key").agg(
        F.max(F.when(mine, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"),
    )
    score = safe_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return sides.where("b IS NOT NULL").agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("silhouette"))


def cluster_metrics(df: DataFrame, features: Sequence[str], cluster: str = "prediction", key: str | None = None) -> DataFrame:
    """One row: status, n_clusters, calinski_harabasz, davies_bouldin and silhouette.

    The silhouette is by squared distance, which needs no comparison of rows;
    with ``key``, a unique row id, ``silhouette_euclidean`` compares all rows.
    """
    found = written(centroids(df, features, cluster), "centroids")
    if found.count() < 2:
        return df.agg(
            F.count_distinct(cluster).alias("n_clusters"), F.lit("insufficient_clusters").alias("status")
        )
    out = _calinski_harabasz(found, len(features)).withColumn("_one", F.lit(1))
    parts = [_davies_bouldin(df, features, cluster, found), _squared_silhouette(df, features, cluster, found)]
    if key:
        parts.append(silhouette(df, key, features, cluster).withColumnRenamed("silhouette", "silhouette_euclidean"))
    for part in parts:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one").withColumn("status", F.lit("success"))


def reduction_metrics(df: DataFrame, original: str, reduced: str, components: np.ndarray, explained: Sequence[float]) -> DataFrame:
    """original_dims, reduced_dims, reduction_ratio, explained_variance, reconstruction_error.

    ``components`` is the (original x reduced) matrix of the fitted reduction;
    as the columns are projected without centring, so is the way back.
    """
    back = F.array(
        *[
            F.aggregate(
                F.zip_with(F.col(reduced), F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w),
                F.lit(0.0),
                lambda s, v: s + v,
            )
            for row in components
        ]
    )
    dims, kept = components.shape
    error = F.avg(_square_gap(F.col(original), back) / dims)
    return df.agg(
        F.lit(dims).alias("original_dims"),
        F.lit(kept).alias("reduced_dims"),
        F.lit(kept / dims).alias("reduction_ratio"),
        F.lit(float(np.sum(explained))).alias("explained_variance"),
        error.alias("reconstruction_error"),
    )


def distance_preservation(df: DataFrame, key: str, original: str, reduced: str, points: int, seed: int = 42) -> DataFrame:
    """Spearman correlation of the pair distances of a sample in two spaces.

    The sample of ``points`` rows is the feature: the measure is defined on it.
    """
    sample = (
        df.select(F.col(key), F.col(original).cast("array<double>").alias("x"), F.col(reduced).cast("array<double>").alias("y"))
        .orderBy(hash_order(key, seed=seed), key)
        .limit(points)
    )

    def reduce(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "u": distances(matrix(a["x"]), matrix(b["x"])).ravel(),
                "v": distances(matrix(a["y"]), matrix(b["y"])).ravel(),
            }
        )

    pairs = block_pairs(sample, sample, key, reduce, "u double, v double")

    def ranks(c: str) -> DataFrame:
        counts = pairs.groupBy(c).agg(F.count("*").alias("n"))
        placed = running_by_value(counts, [], c, ["n"])
        return placed.select(c, (F.col("upto_n") - (F.col("n") - 1) / 2).alias(f"rank_{c}"))

    ranked = pairs.join(ranks("u"), "u").join(ranks("v"), "v")
    return ranked.agg(F.corr("rank_u", "rank_v").alias("distance_preservation"))
