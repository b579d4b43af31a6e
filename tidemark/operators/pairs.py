"""Distances between all rows of two tables, as a blocked shuffle join.

Exact neighbours and silhouettes compare every row with every other. Rows are
hashed to blocks of bounded size; a task gets one block of each side, works on
the two matrices and returns a reduced result (k rows, or one per cluster, for
each left row), never the pairs. No task holds more than two blocks.

Neighbours and silhouettes take wide blocks, as many rows move once per block
of the other side, and walk over a pair of them in tiles. Squared distances of a
tile are one product of matrices; what could be near by them is measured again
coordinate by coordinate, so rounding of the product decides nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import MOST_DIMS, nearest_in_cells

BLOCK_ROWS = 2048
#: Most rows of a wide block, and the blocks a side is dealt to before blocks grow.
WIDE_ROWS, SIDE_BLOCKS = 65_536, 12
#: Rows and columns of a tile, and pairs measured at a time.
TILE_ROWS, TILE_COLUMNS, MEASURED = 1024, 4096, 65_536
#: Blocks of the right table up to which rows of few coordinates are compared with all.
FEW_BLOCKS = 4


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    key: str,
    reduce: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    wide: bool = False,
) -> DataFrame:
    """Union of ``reduce(left block, right block)`` over all pairs of blocks.

    ``wide`` is for a ``reduce`` that holds no matrix over both blocks: blocks of
    large tables then have up to ``WIDE_ROWS`` rows.
    """
    # New column ids on the right, as both sides may come from one table.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    held = lambda n: max(block_rows, min(WIDE_ROWS, n // SIDE_BLOCKS)) if wide else block_rows
    blocks = lambda n: max(1, -(-n // held(n)))
    left_blocks, right_blocks = blocks(left.count()), blocks(right.count())
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    l = left.withColumn("_lb", place(left_blocks)).withColumn("_rb", spread(right_blocks))
    r = right.withColumn("_rb", place(right_blocks)).withColumn("_lb", spread(left_blocks))
    drop = ["_lb", "_rb"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return _empty(names)
        return reduce(a.drop(columns=drop), b.drop(columns=drop))

    names = T.StructType.fromDDL(schema).fieldNames()
    return l.groupBy("_lb", "_rb").cogroup(r.groupBy("_lb", "_rb")).applyInPandas(run, schema)


def _empty(names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame({n: [] for n in names})


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), dtype="float64")


def distances(a: np.ndarray, b: np.ndarray, p: int = 2) -> np.ndarray:
    """Distance matrix, one coordinate at a time so that memory stays at one matrix."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j][:, None] - b[:, j][None, :]
        out += gap * gap if p == 2 else np.abs(gap)
    return np.sqrt(out) if p == 2 else out


def measured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of row i of ``a`` to row i of ``b``, to the bit as ``distances`` gives it."""
    out = np.zeros(len(a))
    for low in range(0, len(a), MEASURED):
        gap = a[low : low + MEASURED] - b[low : low + MEASURED]
        for j in range(gap.shape[1]):
            out[low : low + MEASURED] += gap[:, j] * gap[:, j]
    return np.sqrt(out)


class SquaredGaps:
    """Squared distances of two blocks by products of matrices, in units of ``scale``, off by ``slack`` at most."""

    def __init__(self, a: np.ndarray, b: np.ndarray, kind: type):
        middle = b.mean(0)
        a, b = a - middle, b - middle
        self.scale = float(max(np.abs(a).max(), np.abs(b).max())) * np.sqrt(a.shape[1]) or 1.0
        a, b = a / self.scale, b / self.scale
        one = lambda x: np.ones((len(x), 1))
        square = lambda x: (x * x).sum(1, keepdims=True)
        self.left = np.hstack([-2 * a, square(a), one(a)]).astype(kind)
        self.right = np.hstack([b, one(b), square(b)]).astype(kind)
        self.slack = 8 * (a.shape[1] + 16) * float(np.finfo(kind).eps)

    def tile(self, rows: slice, columns: slice) -> np.ndarray:
        return self.left[rows] @ self.right[columns].T


def _same_ids(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal ids; ``columns`` is sorted."""
    low, high = np.searchsorted(columns, rows, "left"), np.searchsorted(columns, rows, "right")
    n = high - low
    first = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(rows)), n), np.repeat(low, n) + np.arange(n.sum()) - first


def k_closest(a: np.ndarray, b: np.ndarray, k: int, p: int = 2, ids: tuple[np.ndarray, np.ndarray] | None = None,
              reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row of ``a``, row of ``b``, distance: the k nearest of every row, ties to the earlier row of ``b``.

    Rows with equal ``ids`` (those of ``b`` rising) are no neighbours. With
    ``reach`` only rows within that distance are asked for. A distance that is
    not finite is none.
    """
    whole_a, whole_b = np.flatnonzero(np.isfinite(a).all(1)), np.flatnonzero(np.isfinite(b).all(1))
    nothing = np.zeros(0, dtype="int64")
    if not len(whole_a) or not len(whole_b):
        return nothing, nothing, np.zeros(0)
    a, b = a[whole_a], b[whole_b]
    mine, theirs = (ids[0][whole_a], ids[1][whole_b]) if ids else (None, None)
    far = np.full((len(a), k), np.inf)
    if reach is not None:
        far[:] = np.nextafter(reach[whole_a], np.inf)[:, None]
    at = np.full((len(a), k), -1)
    # Few coordinates leave many rows close together, which the shorter type cannot tell apart.
    gaps = SquaredGaps(a, b, np.float32 if a.shape[1] > 16 else np.float64) if p == 2 else None
    for low in range(0, len(a), TILE_ROWS):
        rows = slice(low, low + TILE_ROWS)
        for start in range(0, len(b), TILE_COLUMNS):
            columns = slice(start, start + TILE_COLUMNS)

            def hits() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                tile = gaps.tile(rows, columns) if gaps else distances(a[rows], b[columns], p)
                if ids:
                    tile[_same_ids(mine[rows], theirs[columns])] = np.nan
                slack = gaps.slack if gaps else 0.0
                limit = far[rows, -1]
                limit = (limit / gaps.scale) ** 2 * (1 + 1e-9) + slack if gaps else limit.copy()
                new = np.flatnonzero(~np.isfinite(limit))
                if len(new):
                    n = min(k, tile.shape[1])
                    limit[new] = np.partition(tile[new], n - 1, axis=1)[:, n - 1] + 2 * slack
                    limit[np.isnan(limit)] = np.inf
                    # The product can give less than nothing; the limit is then the slack alone.
                    limit = np.maximum(limit, 2 * slack)
                r, c = np.nonzero(tile <= limit[:, None])
                return r, c, tile

            r, c, tile = hits()
            if gaps and gaps.left.dtype == np.float32 and len(r) > 4 * (k + 16) * len(tile):
                gaps = SquaredGaps(a, b, np.float64)
                r, c, tile = hits()
            if not len(r):
                continue
            d = measured_at(a, b, r + low, c + start) if gaps else tile[r, c]
            touched, place = np.unique(r, return_inverse=True)
            row = np.concatenate([np.repeat(np.arange(len(touched)), k), place])
            all_d = np.concatenate([far[low + touched].ravel(), d])
            all_c = np.concatenate([at[low + touched].ravel(), c + start])
            # An empty place comes after what was found at its distance.
            order = np.lexsort((np.where(all_c < 0, len(b), all_c), all_d, row))
            count = np.bincount(row)
            pick = order[(np.cumsum(count) - count)[:, None] + np.arange(k)]
            far[low + touched], at[low + touched] = all_d[pick], all_c[pick]
    row, place = np.nonzero((at >= 0) & np.isfinite(far))
    return whole_a[row], whole_b[at[row, place]], far[row, place]


def distance_sums(a: np.ndarray, b: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Euclidean distances from every row of ``a`` to the rows of ``b``, added up by ``member`` (rows of b by groups)."""
    out = np.zeros((len(a), member.shape[1]))
    if not np.isfinite(a).all() or not np.isfinite(b).all():
        for low in range(0, len(a), TILE_ROWS):
            out[low : low + TILE_ROWS] = distances(a[low : low + TILE_ROWS], b) @ member
        return out
    gaps = SquaredGaps(a, b, np.float64)
    for low in range(0, len(a), TILE_ROWS):
        for start in range(0, len(b), TILE_COLUMNS):
            rows, columns = slice(low, low + TILE_ROWS), slice(start, start + TILE_COLUMNS)
            tile = gaps.tile(rows, columns)
            # What a difference of large numbers has left over is measured instead.
            r, c = np.nonzero(tile < 1e6 * gaps.slack)
            np.sqrt(np.maximum(tile, 0.0, out=tile), out=tile)
            tile *= gaps.scale
            tile[r, c] = measured_at(a, b, r + low, c + start)
            out[rows] += tile @ member[columns]
    return out


def measured_at(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """``measured`` of chosen pairs, some at a time."""
    parts = [slice(i, i + MEASURED) for i in range(0, len(rows), MEASURED)]
    return np.concatenate([measured(a[rows[s]], b[columns[s]]) for s in parts]) if parts else np.zeros(0)


def vectors(df: DataFrame, key: str, features: Sequence[str] | str, keep: Sequence[str] = ()) -> DataFrame:
    """key, features as array<double>, kept columns; ``features`` may be one array column."""
    if isinstance(features, str):
        packed = F.col(features).cast("array<double>")
    else:
        packed = F.array(*[F.col(c).cast("double") for c in features])
    return df.select(F.col(key), packed.alias("features"), *keep)


def nearest(left: DataFrame, right: DataFrame, key: str, k: int, p: int = 2,
            block_rows: int = BLOCK_ROWS, skip_self: bool = True) -> DataFrame:
    """key, neighbour, distance, place: the k nearest right rows of every left row.

    Both tables are (key, features). Ties go to the smaller neighbour id.
    ``skip_self`` leaves out the row with the same id, for a table against itself.
    Rows of few coordinates and more than a few blocks are found by their cells
    (``cells``); others are compared with all.
    """
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    size = right.select(F.count("*").alias("n"), F.max(F.size("features")).alias("d"), F.min(F.size("features")).alias("e")).first()
    if size["n"] > FEW_BLOCKS * block_rows and 0 < size["e"] == size["d"] <= MOST_DIMS:
        # A row is one id less than the others see, so an id that repeats would need more of them.
        if not skip_self or right.select(key).distinct().count() == size["n"]:
            return place_nearest(nearest_in_cells(left, right, key, k, p, skip_self, k_closest), k)

    def reduce(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(key, kind="stable")
        mine, ids = a[key].to_numpy(), b[key].to_numpy()
        row, column, found = k_closest(matrix(a["features"]), matrix(b["features"]), k, p, (mine, ids) if skip_self else None)
        return pd.DataFrame({"key": mine[row], "neighbour": ids[column], "distance": found})

    best = block_pairs(left, right, key, reduce, "key long, neighbour long, distance double", block_rows, wide=True)
    return place_nearest(best, k)


def place_nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of every key in key, neighbour, distance, with their place."""
    place = F.row_number().over(W.partitionBy("key").orderBy("distance", "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def neighbour_vote(
    train: DataFrame, new: DataFrame, key: str, label: str, k: int = 5,
    weights: str = "uniform", p: int = 2, classify: bool = True, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """key, prediction: majority class (the smaller on a tie) or mean of the k nearest training rows.

    Weights are equal, or one over the distance; an exact match then outweighs the rest.
    """
    found = nearest(new.select(key, "features"), train.select(key, "features"), key, k, p, block_rows, False)
    return vote(found, train, key, label, weights, classify)


def vote(found: DataFrame, train: DataFrame, key: str, label: str, weights: str = "uniform", classify: bool = True) -> DataFrame:
    """key, prediction from neighbours (key, neighbour, distance) and the labels of the training rows."""
    labels = train.select(F.col(key).alias("neighbour"), F.col(label).cast("double").alias("y"))
    voted = found.join(labels, "neighbour")
    if weights == "distance":
        exact = F.max((F.col("distance") == 0).cast("int")).over(W.partitionBy("key"))
        weight = F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
    elif weights == "uniform":
        weight = F.lit(1.0)
    else:
        raise ValueError(f"unknown weights: {weights}")
    voted = voted.withColumn("w", weight)
    if not classify:
        mean = F.sum(F.col("y") * F.col("w")) / F.sum("w")
        return voted.groupBy("key").agg(mean.alias("prediction")).withColumnRenamed("key", key)
    ballots = voted.groupBy("key", "y").agg(F.sum("w").alias("w"))
    best = ballots.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "y")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("b.y").alias("prediction"))


def neighbour_overlap(before: DataFrame, after: DataFrame, key: str, ks: Sequence[int] = (5, 10, 15, 20),
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """k, preservation: mean share of the k nearest rows kept by a reduction. One search per space serves all k."""
    most = max(ks)
    rows = before.count()
    a = nearest(before, before, key, most, 2, block_rows).select("key", "neighbour", F.col("place").alias("i"))
    b = nearest(after, after, key, most, 2, block_rows).select("key", "neighbour", F.col("place").alias("j"))
    both = a.join(b, ["key", "neighbour"])
    usable = [k for k in ks if k < rows]
    counts = both.agg(*[F.count_if((F.col("i") <= k) & (F.col("j") <= k)).alias(f"k{k}") for k in usable])
    pairs = [F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") / F.lit(float(k * rows))).alias("preservation")) for k in usable]
    return counts.select(F.inline(F.array(*pairs)))
