"""Dimension reduction: principal components and truncated singular values, by Spark's own."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    values = df.select(F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL")
    return values.select(array_to_vector("x").alias("x"))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each component with its largest entry positive, so that runs agree."""
    pick = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[pick, np.arange(vectors.shape[1])])


def principal_components(df: DataFrame, vector: str, dims: int, keep: int | float) -> tuple[np.ndarray, np.ndarray]:
    """(dims x k components, explained variance shares). A fraction keeps the fewest that reach it."""
    model = PCA(k=keep if isinstance(keep, int) else dims, inputCol="x", outputCol="z").fit(_vectors(df, vector))
    shares, components = model.explainedVariance.toArray(), model.pc.toArray()
    k = keep if isinstance(keep, int) else int(np.searchsorted(np.cumsum(shares), keep - 1e-12) + 1)
    return _signed(components[:, :k]), shares[:k]


def singular_vectors(df: DataFrame, vector: str, dims: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(dims x k right singular vectors, singular values), without centring."""
    rows = MLUtils.convertVectorColumnsFromML(_vectors(df, vector), "x").rdd.map(lambda r: r[0])
    found = RowMatrix(rows, numCols=dims).computeSVD(k)
    return _signed(found.V.toArray()), found.s.toArray()


def project(df: DataFrame, vector: str, components: np.ndarray, output: str) -> DataFrame:
    """Add the projection as an array column: a product of literals, without Python in the tasks."""
    x = F.col(vector).cast("array<double>")
    dots = [
        F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in column]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        for column in components.T
    ]
    return df.withColumn(output, F.array(*dots))


def component_table(df: DataFrame, shares: Sequence[float]) -> DataFrame:
    """component, share, running_share."""
    rows = [(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(shares, np.cumsum(shares)))]
    return df.sparkSession.createDataFrame(rows, "component int, share double, running_share double")
