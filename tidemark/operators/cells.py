"""Exact neighbours in few dimensions, without comparing all rows.

Rows lie in cells of a k-d tree that a sample of them has cut, about as many in
each. What a row finds in its own cell gives a radius, and only cells whose box
is within it are asked further. The sample decides how even the cells are, not
what comes out. Equal rows are one point with their smallest ids, so that a point
which many rows share is one row of a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import hash_order
from ..functions.scratch import written

#: Rows of a cell, sampled rows that cut one, and the coordinates beyond which boxes exclude next to nothing.
CELL_ROWS, CELL_SAMPLE, MOST_DIMS = 1024, 32, 12


def finite(features: str):
    """Present, and every coordinate a finite number: others have no distance to anything."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.col(features).isNotNull() & F.forall(features, good)


def digest(features: str):
    """Equal features, equal digest; zero has no sign."""
    return F.sha2(F.array_join(F.transform(features, lambda v: (v + 0.0).cast("string")), ","), 256)


def distinct_rows(rows: DataFrame, key: str, most: int) -> DataFrame:
    """i, features, ids: one row per different features, with its smallest ``most`` ids."""
    held = rows.withColumn("_d", digest("features"))
    # Spark keeps only the first ones of a group before the shuffle.
    first = held.withColumn("_n", F.row_number().over(W.partitionBy("_d").orderBy(key))).where(F.col("_n") <= most)
    return first.groupBy("_d").agg(F.min(key).alias("i"), F.min("features").alias("features"), F.sort_array(F.collect_list(key)).alias("ids")).drop("_d")


@dataclass
class Tree:
    """Cuts of a k-d tree of ``depth`` levels in heap order; what is greater than a cut lies on its right."""

    depth: int
    axes: np.ndarray
    cuts: np.ndarray

    def cell(self, x: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(x), dtype="int64"), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[every, self.axes[node]] > self.cuts[node])
        return node - ((1 << self.depth) - 1)


def _cut(sample: np.ndarray, depth: int) -> Tree:
    size = (1 << depth) - 1
    axes, cuts, held = np.zeros(size, dtype="int64"), np.full(size, np.inf), {0: sample}
    for node in range(size):
        x = held.pop(node)
        if len(x) and np.ptp(x, axis=0).max() > 0:
            axes[node] = axis = np.ptp(x, axis=0).argmax()
            values = np.sort(x[:, axis])
            # The middle, or the last value before it that leaves something on the right.
            cuts[node] = min(values[(len(values) - 1) // 2], values[values < values[-1]][-1])
        right = x[:, axes[node]] > cuts[node] if len(x) else np.zeros(0, dtype=bool)
        if 2 * node + 2 < size:
            held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]
    return Tree(depth, axes, cuts)


def fit_tree(points: DataFrame, key: str, rows: int, cell_rows: int = CELL_ROWS) -> Tree:
    """A tree for (key, features): about ``cell_rows`` of ``rows`` rows a cell, cut by ``CELL_SAMPLE`` rows for each cell."""
    depth = max(0, int(np.ceil(np.log2(max(1, rows / cell_rows)))))
    wanted = CELL_SAMPLE << depth
    # The first digits of a hash choose the rows.
    share = F.conv(F.substring(hash_order(key), 1, 8), 16, 10).cast("double") / float(16**8)
    sample = points.where(share < wanted / max(1, rows)).select("features").toPandas()["features"] if depth else []
    return _cut(np.array(list(sample), dtype="float64") if len(sample) else np.zeros((0, 1)), depth)


def placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` with ``cell``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell long"

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=tree.cell(np.array(batch["features"].to_list(), dtype="float64").reshape(len(batch), -1)))

    return rows.mapInPandas(place, schema)


@dataclass
class Boxes:
    """One box per cell that holds rows."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def _length(self, gaps: Iterable[np.ndarray], p: int) -> np.ndarray:
        total = 0.0
        for g in gaps:
            total = total + (g * g if p == 2 else g)
        return np.sqrt(total) if p == 2 else total

    def least(self, x: np.ndarray, p: int) -> np.ndarray:
        """Distances from rows to boxes, a hair less than exact."""
        gap = (np.maximum(0.0, np.maximum(self.low[None, :, j] - x[:, j, None], x[:, j, None] - self.high[None, :, j])) for j in range(x.shape[1]))
        return self._length(gap, p) * (1 - 1e-9)

    def most(self, x: np.ndarray, p: int) -> np.ndarray:
        """Distances from rows to the farthest corners, a hair more than exact."""
        gap = (np.maximum(np.abs(x[:, j, None] - self.low[None, :, j]), np.abs(self.high[None, :, j] - x[:, j, None])) for j in range(x.shape[1]))
        return self._length(gap, p) * (1 + 1e-9)

    def holding(self, x: np.ndarray, k: int, p: int) -> np.ndarray:
        """A radius around each row that surely holds ``k`` rows; infinite if there are fewer."""
        far = self.most(x, p)
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.rows[order], axis=1) >= k
        radius = np.take_along_axis(far, order, 1)[np.arange(len(x)), enough.argmax(axis=1)]
        return np.where(enough.any(axis=1), radius, np.inf)


def boxes_of(cells: DataFrame, dims: int) -> Boxes:
    """The boxes of ``cells`` (features, cell): a few numbers for each cell."""
    ends = [f(F.col("features")[j]).alias(f"{n}{j}") for j in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    found = cells.groupBy("cell").agg(F.count("*").alias("n"), *ends).toPandas().sort_values("cell")
    side = lambda n: found[[f"{n}{j}" for j in range(dims)]].to_numpy(dtype="float64")
    return Boxes(found["cell"].to_numpy(), side("lo"), side("hi"), found["n"].to_numpy())


#: Distances between rows and boxes that a task holds at a time.
HELD = 1_000_000


def to_cells(asked: DataFrame, boxes: Boxes, allowed: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """``asked`` (with features) once for every ``cell`` that ``allowed(rows, matrix)``, a table of rows by boxes, names."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema if f.name != "cell") + ", cell long"
    step = max(1, HELD // max(1, len(boxes.cell)))

    def deal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step].reset_index(drop=True)
                row, box = np.nonzero(allowed(part, np.array(part["features"].to_list(), dtype="float64")))
                if len(row):
                    yield part.iloc[row].drop(columns="cell", errors="ignore").assign(cell=boxes.cell[box])

    return asked.mapInPandas(deal, schema)


def nearest_in_cells(left: DataFrame, right: DataFrame, key: str, k: int, p: int, skip_self: bool, closest: Callable, cell_rows: int = CELL_ROWS) -> DataFrame:
    """key, neighbour, distance: at least the k nearest right rows of every left row, among few more.

    With ``skip_self`` no id of ``right`` may repeat. ``closest`` is ``pairs.k_closest``.
    """
    known = written(distinct_rows(right.where(finite("features")), key, k + 1), "points")
    members = written(left.where(finite("features")).select(F.col(key).alias("key"), "features", digest("features").alias("_d")), "asked")
    asked = written(members.groupBy("_d").agg(F.min("key").alias("q"), F.min("features").alias("features")), "queries")
    first = known.select(F.size("features").alias("n")).first()
    if first is None:
        return left.sparkSession.createDataFrame([], "key long, neighbour long, distance double")
    every = known.select("i", "features").unionByName(asked.select(F.col("q").alias("i"), "features"))
    tree = fit_tree(every, "i", every.count(), cell_rows)
    points = written(placed(known.select("i", "features"), tree), "cells")
    boxes = boxes_of(points, first["n"])
    # A point more than asked for, as the row itself may be one of them.
    most, schema = k + 1, "q long, i long, distance double"

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"q": [], "i": [], "distance": []})
        b = b.sort_values("i", kind="stable")
        x, y = (np.array(s["features"].to_list(), dtype="float64") for s in (a, b))
        row, column, found = closest(x, y, most, p, None, a["radius"].to_numpy() if "radius" in a else None)
        return pd.DataFrame({"q": a["q"].to_numpy()[row], "i": b["i"].to_numpy()[column], "distance": found})

    own = placed(asked.select("q", "features"), tree)
    by_cell = lambda a: a.groupBy("cell").cogroup(points.groupBy("cell")).applyInPandas(meet, schema)
    here = written(by_cell(own), "own")
    seen = here.groupBy("q").agg(F.when(F.count("*") >= most, F.max("distance")).alias("radius"))
    open_ = own.join(seen, "q", "left").select("q", "features", "cell", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))

    def within(rows: pd.DataFrame, x: np.ndarray) -> np.ndarray:
        radius = rows["radius"].to_numpy()
        wide = np.isinf(radius)
        if wide.any():
            radius = radius.copy()
            radius[wide] = boxes.holding(x[wide], most, p)
        return (boxes.least(x, p) <= radius[:, None]) & (boxes.cell[None, :] != rows["cell"].to_numpy()[:, None])

    found = here.unionByName(by_cell(to_cells(open_, boxes, within)))
    place = F.row_number().over(W.partitionBy("q").orderBy("distance", "i"))
    few = found.withColumn("_n", place).where(F.col("_n") <= most).join(known.select("i", "ids"), "i")
    # The first ids of all copies, and one more for the row itself.
    named = few.select("q", "distance", F.explode("ids").alias("neighbour"))
    named = named.withColumn("_n", F.row_number().over(W.partitionBy("q").orderBy("distance", "neighbour"))).where(F.col("_n") <= most)
    answers = members.select("key", "_d").join(asked.select("_d", "q"), "_d").join(named, "q")
    if skip_self:
        answers = answers.where("key <> neighbour")
    return answers.select("key", "neighbour", "distance")
