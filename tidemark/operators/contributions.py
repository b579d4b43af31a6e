"""What each feature adds to the prediction of a row, for tree models.

On its way down a tree a row's expected value changes at every split; the
change is put to the feature that was split on. Over all trees these changes
and the values of the roots add up to the prediction. The nodes of a fitted
model are a table of a size fixed by the model; every task holds them as arrays
and takes all rows of a batch down one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import union_all
from ..functions.scratch import scratch_path


@dataclass
class Forest:
    """The nodes of all trees, end to end: children by number, -1 at a leaf, and each node's value times its tree's weight."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    #: Categories that go left, by node, where a split is on categories.
    categories: dict[int, np.ndarray]

    @property
    def base(self) -> float:
        return float(self.value[self.roots].sum())

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """rows x features: the sum of all changes of value by the feature that made them."""
        out = np.zeros(x.shape)
        for root in self.roots:
            at = np.full(len(x), root)
            rows = np.arange(len(x)) if self.left[root] >= 0 else np.zeros(0, np.int64)
            while len(rows):
                node = at[rows]
                used = self.feature[node]
                seen = x[rows, used]
                goes_left = seen <= self.threshold[node]
                for n in self.categories.keys() & set(node.tolist()) if self.categories else ():
                    here = node == n
                    goes_left[here] = np.isin(seen[here], self.categories[n])
                below = np.where(goes_left, self.left[node], self.right[node])
                # A row stands once in ``rows``, so no place is added to twice.
                out[rows, used] += self.value[below] - self.value[node]
                at[rows] = below
                rows = rows[self.left[below] >= 0]
        return out


def forest_of(model: Model, target_class: int = 1) -> Forest:
    """The trees of a fitted tree model of Spark.

    Values are what the model adds up: a number for regression, the share of
    ``target_class`` for trees and forests of classes, and the margin (log odds
    by two) for boosted classes.
    """
    boosted = type(model).__name__.startswith("GBT")
    of_classes = getattr(model, "numClasses", None) is not None and not boosted
    if not hasattr(model, "toDebugString"):
        raise ValueError(f"{type(model).__name__} is no tree model")
    path = scratch_path(_session(), "trees")
    model.write().save(path)
    nodes = _session().read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
        weights = list(model.treeWeights)
        if not boosted:
            # A forest is the mean of its trees.
            weights = [1.0 / len(weights)] * len(weights)
    else:
        nodes, weights = nodes.withColumn("treeID", F.lit(0)), [1.0]
    found = nodes.orderBy("treeID", "id").collect()
    place = {(r["treeID"], r["id"]): i for i, r in enumerate(found)}
    value = lambda r: r["impurityStats"][target_class] / (sum(r["impurityStats"]) or 1.0) if of_classes else r["prediction"]
    child = lambda r, side: place[r["treeID"], r[side]] if r["leftChild"] >= 0 else -1
    on_categories = {i: np.array(r["split"]["leftCategoriesOrThreshold"]) for i, r in enumerate(found) if r["split"]["numCategories"] >= 0}
    threshold = [r["split"]["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 and i not in on_categories else 0.0 for i, r in enumerate(found)]
    return Forest(
        np.array([max(0, r["split"]["featureIndex"]) for r in found]), np.array(threshold),
        np.array([child(r, "leftChild") for r in found]), np.array([child(r, "rightChild") for r in found]),
        np.array([value(r) * weights[r["treeID"]] for r in found]), np.array([i for i, r in enumerate(found) if r["id"] == 0]), on_categories,
    )


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def feature_contributions(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), target_class: int = 1) -> DataFrame:
    """keep, base, one column per feature, and ``total``: base plus all contributions, which is what the model predicts.

    ``model`` ends in a tree, a forest or boosted trees over the assembled
    ``features``; its earlier stages are applied first. For classes the total is
    the probability of ``target_class`` (boosted: the margin).
    """
    forest = forest_of(model.stages[-1], target_class)
    ready = PipelineModel(model.stages[:-1]).transform(df)
    k = len(features)
    slim = ready.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(True).alias("_")).alias("kept"), vector_to_array("features").alias("x"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            c = forest.contributions(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(forest.base + c.sum(axis=1))], ["kept", "c", "total"])

    out = slim.mapInArrow(work, f"kept {slim.schema['kept'].dataType.simpleString()}, c array<double>, total double")
    return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], F.lit(forest.base).alias("base"), *[F.col("c")[i].alias(f) for i, f in enumerate(features)], "total")


def contribution_summary(contributions: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, mean_size, mean: how much a feature moves predictions on average, and in which direction."""
    row = contributions.agg(*[e for f in features for e in (F.avg(F.abs(f"`{f}`")).alias(f"s_{f}"), F.avg(f"`{f}`").alias(f"m_{f}"))])
    return union_all([row.select(F.lit(f).alias("feature"), F.col(f"s_{f}").alias("mean_size"), F.col(f"m_{f}").alias("mean")) for f in features])
