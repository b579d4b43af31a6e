"""Density-based clustering on a grid, as joins.

The cells of the grid are small enough that any two points of a cell are
neighbours. A cell with enough points needs no distances at all: all of them
are core points of one cluster. Distances are only computed for the few points
of sparse cells, and between neighbouring cells to see whether they connect.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import dense_codes
from ..functions.scratch import cut


def _distance(a: Sequence[Column], b: Sequence[Column], metric: str) -> Column:
    parts = [(x - y) * (x - y) if metric == "euclidean" else F.abs(x - y) for x, y in zip(a, b)]
    total = sum(parts[1:], parts[0])
    return F.sqrt(total) if metric == "euclidean" else total


def _offsets(dims: int, metric: str) -> list[tuple[int, ...]]:
    """Cells that may hold a neighbour: their nearest corners are within eps. Own cell left out."""
    reach = (math.isqrt(dims) if metric == "euclidean" else dims) + 1
    side = 1 / math.sqrt(dims) if metric == "euclidean" else 1 / dims
    out = []
    for o in itertools.product(range(-reach, reach + 1), repeat=dims):
        gaps = [max(0, abs(v) - 1) * side for v in o]
        near = math.sqrt(sum(g * g for g in gaps)) if metric == "euclidean" else sum(gaps)
        if any(o) and near <= 1 + 1e-9:
            out.append(o)
    return out


def _moved(cell: str, offsets: Sequence[tuple[int, ...]]) -> Column:
    """The neighbouring cells of a cell (an array of whole numbers), one row each."""
    shifts = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in offsets])
    return F.explode(F.transform(shifts, lambda o: F.zip_with(F.col(cell), o, lambda a, b: a + b)))


def connected(edges: DataFrame) -> DataFrame:
    """node, root from an edge table (u, v) of numbers: every node with the smallest of its component.

    Alternating star contraction: each round links nodes to the smallest node
    they know of, first outwards, then inwards. The rounds grow with the
    logarithm of the component size. Each round is written, so that the plan
    does not grow and a lost executor costs one round.
    """
    pairs = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        own = low.select("u", F.col("m").alias("v"))
        pairs = cut(small.unionByName(own).where("u <> v").distinct())
        # Sums of the edges decide whether the round changed anything.
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def dbscan(df: DataFrame, key: str, features: Sequence[str], eps: float, min_samples: int,
           metric: str = "euclidean") -> DataFrame:
    """key, cluster, core: clusters numbered by their smallest core row, -1 for noise.

    Rows with a missing coordinate are left out. A border point within reach of several clusters joins that of its nearest
    core point.
    """
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric: {metric}")
    dims = len(features)
    # A hair less than exact keeps the diagonal of a cell within eps.
    side = eps / (math.sqrt(dims) if metric == "euclidean" else dims) * (1 - 1e-12)
    offsets = _offsets(dims, metric)
    names = [f"x{i}" for i in range(dims)]
    place = F.array(*[F.floor(F.col(n) / F.lit(side)).cast("long") for n in names])

    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)])
    # Equal points are one point with a weight.
    points = cut(rows.groupBy(*names).agg(F.count("*").alias("w"), F.min("key").alias("id")).withColumn("cell", place))
    cells = points.groupBy("cell").agg(F.sum("w").alias("cell_w"))
    weighed = points.join(cells, "cell")
    dense = weighed.where(F.col("cell_w") >= min_samples)
    sparse = weighed.where(F.col("cell_w") < min_samples)

    # A sparse cell has fewer than min_samples points, so a full neighbour cell
    # meets a bounded number of them, however full it is.
    a = [F.col(f"a.{n}") for n in names]
    b = [F.col(f"b.{n}") for n in names]
    close = _distance(a, b, metric) <= eps
    asking = sparse.select("id", "cell_w", *names, _moved("cell", offsets).alias("cell")).alias("a")
    around = (
        asking.join(points.alias("b"), F.col("a.cell") == F.col("b.cell"))
        .where(close)
        .groupBy("a.id")
        .agg(F.sum("b.w").alias("near_w"))
    )
    judged = sparse.join(around, "id", "left").withColumn(
        "core", F.col("cell_w") + F.coalesce("near_w", F.lit(0)) >= min_samples
    )
    cols = ["id", "w", "cell", *names, "core"]
    marked = cut(dense.withColumn("core", F.lit(True)).select(*cols).unionByName(judged.select(*cols)))
    core = marked.where("core")

    # Cells are named by their smallest core point.
    cores = core.groupBy("cell").agg(F.min("id").alias("cell_id"))
    core = cut(core.join(cores, "cell").select("cell", "cell_id", "id", *names))

    # First the point of a cell nearest to the centre of each neighbour cell:
    # for most neighbours two such points settle that they connect.
    asked = core.select("cell", "cell_id", "id", *names, _moved("cell", offsets).alias("other"))
    middle = [(F.col("other")[i] + 0.5) * side for i in range(dims)]
    nearest = asked.groupBy("cell", "cell_id", "other").agg(
        F.min_by(F.struct(*names), F.struct(_distance([F.col(n) for n in names], middle, metric), F.col("id"))).alias("p")
    )
    left, right = nearest.alias("l"), nearest.alias("r")
    meet = left.join(right, (F.col("l.other") == F.col("r.cell")) & (F.col("l.cell") == F.col("r.other")))
    meet = meet.where(F.col("l.cell_id") > F.col("r.cell_id"))
    probe = _distance([F.col(f"l.p.{n}") for n in names], [F.col(f"r.p.{n}") for n in names], metric) <= eps
    tried = cut(
        meet.select(
            F.col("l.cell").alias("cu"), F.col("r.cell").alias("cv"),
            F.col("l.cell_id").alias("u"), F.col("r.cell_id").alias("v"), probe.alias("linked"),
        )
    )
    links = tried.where("linked").select("u", "v")

    # Pairs of cells the probe left open are settled by their points, each side
    # narrowed to those within eps of the other cell's box.
    open_pairs = tried.where("NOT linked").select("cu", "cv", "u", "v")

    def in_reach(own: str, other: str) -> DataFrame:
        side_points = open_pairs.join(core.select(F.col("cell").alias(own), *names), own)
        gaps = []
        for i, n in enumerate(names):
            low = F.col(other)[i] * side
            gaps.append(F.greatest(F.lit(0.0), low - F.col(n), F.col(n) - (low + side)))
        zero = [F.lit(0.0)] * dims
        return side_points.where(_distance(gaps, zero, metric) <= eps * (1 + 1e-9)).select("u", "v", *names)

    more = (
        in_reach("cu", "cv").alias("a")
        .join(in_reach("cv", "cu").alias("b"), (F.col("a.u") == F.col("b.u")) & (F.col("a.v") == F.col("b.v")))
        .where(close)
        .select("a.u", "a.v")
        .distinct()
    )
    roots = connected(links.unionByName(more))
    labelled = core.join(roots, F.col("cell_id") == F.col("node"), "left").select(
        "cell", "id", *names, F.coalesce("root", "cell_id").alias("root")
    )

    # Points that are not core look for the nearest core point around them.
    edge = marked.where("NOT core")
    here = edge.select("id", *names, _moved("cell", [*offsets, tuple([0] * dims)]).alias("cell")).alias("a")
    reached = (
        here.join(labelled.alias("b"), F.col("a.cell") == F.col("b.cell"))
        .where(close)
        .groupBy(F.col("a.id").alias("id"))
        .agg(F.min_by("b.root", F.struct(_distance(a, b, metric), F.col("b.root"))).alias("root"))
    )
    found = labelled.select("id", "root", F.lit(True).alias("core")).unionByName(
        edge.select("id").join(reached, "id", "left").select("id", "root", F.lit(False).alias("core"))
    )
    numbers = dense_codes(found.where("root IS NOT NULL"), "root")
    per_point = found.join(numbers, "root", "left").select("id", "core", F.coalesce("code", F.lit(-1)).alias("cluster"))
    coded = points.join(per_point, "id").select(*names, "cluster", "core")
    return rows.join(coded, names).select(F.col("key").alias(key), "cluster", "core")
