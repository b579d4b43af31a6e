"""Agglomerative clustering by single linkage, as a minimum spanning tree grown in rounds.

Joining the two nearest clusters again and again adds the edges of the minimum
spanning tree in rising order; leaving out its longest ones gives any number of
clusters. In a round every component picks its shortest edge to another one, so
components at least halve in number, and a table of a billion rows takes thirty
rounds. Edges come from the nearest neighbours of every row. Where these all
lie in a row's own component and could hide a shorter edge than the component
knows of, the row is searched for its nearest row outside: in few dimensions in
the cells (``cells``) that can hold it, else among all rows. Equal rows are
joined first, at distance 0 to their smallest id, and go on as one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import dense_codes
from ..functions.scratch import written
from .dbscan import connected
from .cells import MOST_DIMS, Boxes, boxes_of, digest, finite, fit_tree, placed, to_cells
from .pairs import BLOCK_ROWS, FEW_BLOCKS, block_pairs, distances, matrix, nearest, vectors


@dataclass
class Linkage:
    """The tree: ``edges`` (a, b, distance), and ``rows`` with the ids of all rows under ``key``."""

    key: str
    rows: DataFrame
    edges: DataFrame

    def clusters(self, k: int) -> DataFrame:
        """key, cluster: ``k`` clusters, or as many as there are rows or separate trees; numbered by their smallest row."""
        n, joins = self.rows.count(), self.edges.count()
        # Trees that no edge joins are clusters already.
        cut_off = max(0, min(k, n) - (n - joins))
        longest = self.edges.orderBy(F.desc("distance"), F.desc("a"), F.desc("b")).limit(cut_off)
        return self._named(self.edges.join(longest, ["a", "b"], "left_anti"))

    def clusters_within(self, distance: float) -> DataFrame:
        """key, cluster: rows that a chain of steps of at most ``distance`` connects."""
        return self._named(self.edges.where(F.col("distance") <= distance))

    def _named(self, kept: DataFrame) -> DataFrame:
        parts = connected(kept.select(F.col("a").alias("u"), F.col("b").alias("v")))
        own = self.rows.join(parts.withColumnRenamed("node", self.key), self.key, "left").select(self.key, F.coalesce("root", self.key).alias("_c"))
        held = written(own, "clusters")
        return held.join(dense_codes(held, "_c"), "_c").select(self.key, F.col("code").cast("int").alias("cluster"))


def single_linkage(df: DataFrame, key: str, features: Sequence[str] | str, neighbours: int = 10, p: int = 2, block_rows: int = BLOCK_ROWS) -> Linkage:
    """The single-linkage tree over all rows; ``key`` is a unique whole number.

    ``p`` is 1 for manhattan and 2 for euclidean distance. ``neighbours`` decides
    how much is compared beforehand, not what comes out. Of equal distances
    the edge with the smaller ids comes first.
    """
    v = written(vectors(df.withColumn(key, F.col(key).cast("long")), key, features).where(F.col("features").isNotNull()), "vectors")
    first = written(v.where(finite("features")).groupBy(digest("features").alias("_d")).agg(F.min(key).alias(key), F.min("features").alias("features"), F.collect_set(key).alias("_same")), "points")
    copies = first.select(F.col(key).alias("a"), F.explode(F.array_remove("_same", F.col(key))).alias("b"), F.lit(0.0).alias("distance"))
    points = first.select(key, "features")
    near = written(nearest(points, points, key, neighbours, p, block_rows), "near")
    cells = _cells(points, key, block_rows)
    edge = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col("distance")]
    edges = written(near.select(edge("key", "neighbour")).distinct(), "edges")
    # How far each row has seen: everything, if it knows fewer rows than it asked for.
    seen = near.groupBy("key").agg(F.count("*").alias("_n"), F.max("distance").alias("_far"))
    reach = written(points.select(F.col(key).alias("key")).join(seen, "key", "left").select("key", F.when(F.col("_n") >= neighbours, F.col("_far")).alias("_far")), "reach")
    parts = points.select(F.col(key).alias("node"), F.col(key).alias("part"))
    tree = written(copies, "tree")
    while True:
        parts = written(parts, "parts")
        best = written(_shortest(edges, parts), "shortest")
        more = _beyond_sight(points, key, near, reach, parts, best, p, block_rows, cells)
        if more is not None:
            edges = written(edges.unionByName(more.select(edge("key", "neighbour"))).distinct(), "edges")
            best = written(_shortest(edges, parts), "shortest")
        if best.isEmpty():
            return Linkage(key, v.select(key), tree)
        chosen = best.select("a", "b", "distance").distinct()
        tree = written(tree.unionByName(chosen), "tree")
        ends = best.select(F.col("part").alias("u"), F.col("other").alias("v"))
        joined = connected(ends).select(F.col("node").alias("part"), "root")
        parts = parts.join(joined, "part", "left").select("node", F.coalesce("root", "part").alias("part"))


def _shortest(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """part, other, a, b, distance: the shortest edge that leaves each component; one order of all edges, so that no circle is closed."""
    of = lambda n, c: parts.select(F.col("node").alias(n), F.col("part").alias(c))
    crossing = edges.join(of("a", "_p"), "a").join(of("b", "_q"), "b").where("_p <> _q")
    sides = F.explode(F.array(F.struct(F.col("_p").alias("part"), F.col("_q").alias("other")), F.struct(F.col("_q").alias("part"), F.col("_p").alias("other"))))
    both = crossing.select("a", "b", "distance", sides.alias("s"))
    least = both.groupBy("s.part").agg(F.min(F.struct("distance", "a", "b", F.col("s.other").alias("other"))).alias("m"))
    return least.select("part", "m.other", "m.a", "m.b", "m.distance")


def _cells(points: DataFrame, key: str, block_rows: int) -> tuple[DataFrame, Boxes] | None:
    """The points with their cells, and the boxes; nothing for few points or many coordinates."""
    size = points.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    if size["n"] <= FEW_BLOCKS * block_rows or not 0 < size["d"] <= MOST_DIMS:
        return None
    held = written(placed(points, fit_tree(points, key, size["n"])), "cells")
    return held, boxes_of(held, size["d"])


def _beyond_sight(v: DataFrame, key: str, near: DataFrame, reach: DataFrame, parts: DataFrame, best: DataFrame, p: int, block_rows: int,
                  cells: tuple[DataFrame, Boxes] | None = None) -> DataFrame | None:
    """key, neighbour, distance: the nearest row outside for rows that may have a shorter edge than their component knows of.

    The largest component needs none: the others find the edges to it.
    """
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max(F.struct("n", "part")).alias("m")).first()["m"]
    if largest is None or sizes.count() < 2:
        return None
    of = lambda n, c: parts.select(F.col("node").alias(n), F.col("part").alias(c))
    sees_out = near.join(of("key", "_p"), "key").join(of("neighbour", "_q"), "neighbour").where("_p <> _q").select("key").distinct()
    inside = parts.where(F.col("part") != largest["part"]).withColumnRenamed("node", "key").join(sees_out, "key", "left_anti")
    doubtful = inside.join(reach.where("_far IS NOT NULL"), "key").join(best.select("part", "distance"), "part", "left")
    doubtful = doubtful.where("distance IS NULL OR _far <= distance").select(F.col("key").alias(key), "part", F.coalesce("distance", F.lit(float("inf"))).alias("known"))
    asked = written(v.join(doubtful, key), "asked")
    if asked.isEmpty():
        return None
    others = v.join(parts.withColumnRenamed("node", key), key)

    def nearest_outside(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"key": [], "neighbour": [], "distance": []})
        b = b.sort_values(key, kind="stable")
        x, y, best_d, best_at = matrix(a["features"]), matrix(b["features"]), [], []
        for low in range(0, len(a), BLOCK_ROWS):
            d = distances(x[low : low + BLOCK_ROWS], y, p)
            d[a["part"].to_numpy()[low : low + BLOCK_ROWS, None] == b["part"].to_numpy()[None, :]] = np.inf
            best_at.append(d.argmin(axis=1))
            best_d.append(d.min(axis=1))
        out = pd.DataFrame({"key": a[key].to_numpy(), "neighbour": b[key].to_numpy()[np.concatenate(best_at)], "distance": np.concatenate(best_d)})
        return out[np.isfinite(out["distance"])]

    schema = "key long, neighbour long, distance double"
    if cells is None:
        found = block_pairs(asked, others, key, nearest_outside, schema, block_rows)
    else:
        held, boxes = cells
        theirs = written(held.join(parts.withColumnRenamed("node", key), key), "others")
        ends = theirs.groupBy("cell").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).toPandas().sort_values("cell")
        low, high = ends["lo"].to_numpy(), ends["hi"].to_numpy()

        def within(rows: pd.DataFrame, x: np.ndarray) -> np.ndarray:
            part = rows["part"].to_numpy()[:, None]
            # A cell that holds a row of another part has one no farther than its farthest corner.
            foreign = (low[None, :] != part) | (high[None, :] != part)
            sure = np.where(foreign, boxes.most(x, p), np.inf).min(axis=1)
            return foreign & (boxes.least(x, p) <= np.minimum(sure, rows["known"].to_numpy())[:, None])

        found = to_cells(asked, boxes, within).groupBy("cell").cogroup(theirs.groupBy("cell")).applyInPandas(nearest_outside, schema)
    first = found.groupBy("key").agg(F.min(F.struct("distance", "neighbour")).alias("m"))
    return first.select("key", F.col("m.neighbour").alias("neighbour"), F.col("m.distance").alias("distance"))
