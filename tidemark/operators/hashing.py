"""Nearest neighbours by bucketed random projections, for tables too large to compare row by row.

Every table of the index is a tree of buckets: a bucket that holds more rows
than wanted is divided by the next projection, so buckets are small however the
rows lie. A row is compared with the rows of its bucket in every table, and
the candidates are ranked by their true distances. The share of true neighbours
that is found is measured at fit, and tables are added until it is as wanted. Where
the share of the tables so far says that the most tables would not reach it, as
of data without structure, all rows are compared instead.

Rows with equal features cannot be told apart by any projection. They enter as
one, with as many of their smallest ids as can be among the nearest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import first_by_hash
from ..functions.scratch import LOOKUP_ROWS, join_lookup, written
from .cells import digest, distinct_rows
from .pairs import k_closest, matrix, nearest, place_nearest

NODE = "node"
#: Halvings of a digit's width between the first and the finest, and levels of buckets counted in one pass.
FINEST, LEVELS = 6, 6


class NeighbourIndex:
    """A fitted index: projections, the rows with their buckets, and the divided buckets of each table."""

    def __init__(self, key: str, most: int, p: int, bucket_rows: int, tables: int, digits: int, projections: BucketedRandomProjectionLSHModel,
                 rows: DataFrame, placed: DataFrame, divided: DataFrame, depth: int, recall: float | None = None, exact: bool = False):
        self.key, self.most, self.p, self.bucket_rows, self.tables, self.digits = key, most, p, bucket_rows, tables, digits
        self.projections, self.rows, self.placed, self.divided, self.depth, self.recall, self.exact = projections, rows, placed, divided, depth, recall, exact

    def settings(self) -> dict:
        return {n: getattr(self, n) for n in ("key", "most", "p", "bucket_rows", "tables", "digits", "depth", "recall", "exact")}

    def write(self, path: str) -> None:
        self.projections.write().overwrite().save(f"{path}/projections")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.placed.write.mode("overwrite").parquet(f"{path}/placed")
        self.divided.write.mode("overwrite").parquet(f"{path}/divided")

    @classmethod
    def read(cls, spark: SparkSession, path: str, settings: dict) -> "NeighbourIndex":
        projections = BucketedRandomProjectionLSHModel.load(f"{path}/projections")
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("rows", "placed", "divided")}
        return cls(**settings, projections=projections, **tables)

    def nearest(self, queries: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
        """key, neighbour, distance, place as ``pairs.nearest`` gives them, among the candidates of the buckets.

        ``queries`` is (key, features array<double>). A row of the index with
        equal features is a neighbour at distance 0; ``skip_self`` leaves out
        the one with the same id. ``k`` is at most ``most`` of the fit.
        """
        if k > self.most:
            raise ValueError(f"the index was fitted for at most {self.most} neighbours")
        key = self.key
        # Equal queries are asked once.
        asked = written(queries.where(F.col("features").isNotNull()).withColumn("_d", digest("features")), "asked")
        distinct = asked.groupBy("_d").agg(F.min(key).alias("_q"), F.min("features").alias("features"))
        if self.exact:
            new, held = (df.select(F.col(c).alias(key), "features") for df, c in ((distinct, "_q"), (self.rows, "i")))
            all_rows = nearest(new, held, key, k + 1, self.p, skip_self=False).select(F.col("key").alias("q"), F.col("neighbour").alias("i"), "distance")
            best = all_rows.join(self.rows.select("i", "ids"), "i")
        else:
            located = _located(_hashed(self.projections, distinct, self.tables, self.digits), self.divided, self.depth)
            best = _ranked_in_buckets(located, self.placed, k + 1, self.p, self.bucket_rows)
        # One id may be found in several tables.
        found = best.groupBy("q", "i").agg(F.min("distance").alias("distance"), F.first("ids").alias("ids"))
        place = F.row_number().over(W.partitionBy("q").orderBy("distance", "i"))
        few = found.withColumn("_n", place).where(F.col("_n") <= k + 1)
        named = few.select("q", "distance", F.explode("ids").alias("neighbour"))
        members = asked.select(F.col(key).alias("key"), "_d").join(distinct.select("_d", F.col("_q").alias("q")), "_d").select("q", "key")
        answers = members.join(named, "q").drop("q")
        if skip_self:
            answers = answers.where(F.col("key") != F.col("neighbour"))
        return place_nearest(answers, k)


def _hashed(projections: BucketedRandomProjectionLSHModel, rows: DataFrame, tables: int, digits: int) -> DataFrame:
    """One row per row and table, with ``nodes``: the buckets it may be in, from the largest to the smallest."""
    hashed = projections.transform(rows.withColumn("_v", array_to_vector("features"))).drop("_v")
    flat = F.transform("_h", lambda v: vector_to_array(v)[0].cast("long"))
    # Later digits are finer, so that rows which lie close together are told apart in the end.
    coarse = lambda v, i: F.floor(v / F.pow(F.lit(2.0), F.greatest(F.lit(0), F.lit(FINEST) - F.floor(i / 3)))).cast("long")
    paths = F.array(*[F.struct(F.lit(t).alias("t"), F.transform(F.slice("_f", t * digits + 1, digits), coarse).alias("s")) for t in range(tables)])
    dealt = hashed.withColumn("_f", flat).drop("_h").withColumn("_p", F.explode(paths)).drop("_f")
    # A bucket is named by its table and the digits that lead to it.
    nodes = F.array(*[F.xxhash64("_p.t", F.slice("_p.s", 1, m)) for m in range(digits + 1)])
    return dealt.withColumn("nodes", nodes).drop("_p")


def _located(hashed: DataFrame, divided: DataFrame, depth: int) -> DataFrame:
    """``node``: the first bucket of the path that was not divided; no path has more than ``depth`` divided ones."""
    out = hashed.withColumn(NODE, F.col("nodes")[0])
    few = divided.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS if depth else True
    lookup = F.broadcast(divided) if few else divided
    for m in range(depth):
        # One table for all levels: if it was counted to be small it is broadcast once.
        out = out.join(lookup.select(F.col(NODE), F.lit(True).alias("_open")), NODE, "left")
        out = out.withColumn(NODE, F.when(F.col("_open"), F.col("nodes")[m + 1]).otherwise(F.col(NODE))).drop("_open")
    return out.drop("nodes")


def _divide(hashed: DataFrame, digits: int, bucket_rows: int) -> tuple[DataFrame, int]:
    """node: the buckets of more than ``bucket_rows`` rows, which the next digit divides; and the longest path of them.

    A few levels are counted at a time, of the rows whose bucket was still too
    full. What holds too many rows lies in larger buckets that do so too.
    """
    divided, depth = hashed.select(F.lit(0).cast("long").alias(NODE)).limit(0), 0
    while depth < digits:
        levels = min(LEVELS, digits - depth)
        parts = F.array(*[F.struct(F.col("nodes")[depth + i].alias(NODE), F.lit(depth + i).alias("level")) for i in range(levels)])
        open_ = hashed if not depth else hashed.join(full.where(F.col("level") == depth - 1).select(F.col(NODE).alias("_n")), F.col("nodes")[depth - 1] == F.col("_n"), "left_semi")
        counts = open_.select(F.inline(parts)).groupBy(NODE, "level").agg(F.count("*").alias("_n"))
        full = written(counts.where(F.col("_n") > bucket_rows).select(NODE, "level"), "divided")
        deepest = full.agg(F.max("level")).first()[0]
        if deepest is None:
            break
        divided, reached = divided.unionByName(full.select(NODE)), depth + levels
        depth = deepest + 1
        if depth < reached:
            break
    return written(divided, "divided"), depth


def _ranked_in_buckets(asked: DataFrame, placed: DataFrame, k: int, p: int, bucket_rows: int) -> DataFrame:
    """q, i, distance, ids: for every query its k nearest rows of each bucket it is in.

    Queries of one bucket, and rows of a bucket that no digit divides, are dealt
    to blocks of ``bucket_rows``; a task compares one block with another.
    """
    blocks = lambda df, c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    count = lambda df, n: df.groupBy(NODE).agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias(n))
    sizes = written(count(placed, "_nb").join(count(asked, "_na"), NODE).select(NODE, "_na", "_nb"), "sizes")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = join_lookup(asked, sizes, [NODE]).withColumn("_a", blocks(asked, "_q", "_na")).withColumn("_b", spread("_nb"))
    b = join_lookup(placed, sizes, [NODE]).withColumn("_b", blocks(placed, "i", "_nb")).withColumn("_a", spread("_na"))
    a, b = a.select(NODE, "_a", "_b", "_q", "features"), b.select(NODE, "_a", "_b", "i", "features", "ids")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "i": [], "distance": [], "ids": []})
        right = right.sort_values("i", kind="stable")
        row, column, found = k_closest(matrix(left["features"]), matrix(right["features"]), k, p)
        ids = right["ids"].to_numpy()
        return pd.DataFrame({"q": left["_q"].to_numpy()[row], "i": right["i"].to_numpy()[column], "distance": found, "ids": list(ids[column])})

    cells = [NODE, "_a", "_b"]
    return a.groupBy(*cells).cogroup(b.groupBy(*cells)).applyInPandas(compare, "q long, i long, distance double, ids array<long>")


def fit_index(rows: DataFrame, key: str, most: int = 20, p: int = 2, recall: float = 0.9, tables: int = 4, most_tables: int = 64,
              digits: int = 24, bucket_rows: int = 1024, probes: int = 128, seed: int = 42) -> NeighbourIndex:
    """An index over (key, features array<double>) for up to ``most`` neighbours.

    Of ``probes`` rows, drawn by hash, the true neighbours are found by
    comparing them with all rows; tables are doubled from ``tables`` until the
    index finds a share of ``recall`` of them. If ``most_tables`` would not, the
    index compares all rows (``index.exact``). The share is kept as
    ``index.recall``. Rows without features take no part.
    """
    present = rows.select(F.col(key).cast("long").alias(key), "features").where(F.col("features").isNotNull())
    distinct = written(distinct_rows(present, key, most + 1), "rows")
    vectors = distinct.select("i", array_to_vector("features").alias("_v"))
    spread = vectors.agg(Summarizer.variance(F.col("_v")).alias("v")).first()["v"] if not distinct.isEmpty() else None
    total = float(np.sum(spread.toArray())) if spread is not None else 0.0
    # A projection has this deviation on average; a digit of that width takes a handful of values.
    length = (math.sqrt(total / len(spread)) if total > 0 else 1.0) / 2**FINEST
    sample = written(first_by_hash(distinct.select(F.col("i").alias(key), "features"), [], key, probes, seed), "probes")
    truth = None
    while True:
        maker = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=length, numHashTables=tables * digits, seed=seed)
        # An empty table has no width to learn from; any projection serves.
        known = vectors if spread is not None else rows.sparkSession.range(1).select(array_to_vector(F.array(F.lit(0.0))).alias("_v"))
        projections = maker.fit(known)
        hashed = written(_hashed(projections, distinct, tables, digits), "hashed")
        divided, depth = _divide(hashed.select("nodes"), digits, bucket_rows)
        placed = written(_located(hashed, divided, depth), "placed")
        index = NeighbourIndex(key, most, p, bucket_rows, tables, digits, projections, distinct, placed, divided, depth)
        k = min(most, 20)
        if truth is None:
            truth = written(nearest(sample, present, key, k, p), "truth")
        index.recall = found_share(index.nearest(sample, k), truth)
        if index.recall is None or index.recall >= recall:
            return index
        # Tables find a neighbour independently of each other.
        if tables >= most_tables or 1 - (1 - index.recall) ** (most_tables / tables) < recall:
            index.exact = True
            index.recall = found_share(index.nearest(sample, k), truth)
            return index
        tables = min(most_tables, 2 * tables)


def found_share(found: DataFrame, truth: DataFrame) -> float | None:
    """The share of true neighbours that were found; one as near as the farthest true one counts."""
    farthest = truth.groupBy("key").agg(F.max("distance").alias("_far"), F.count("*").alias("n"))
    hit = F.count_if(F.coalesce(F.col("distance") <= F.col("_far"), F.lit(False)))
    per = farthest.join(found, "key", "left").groupBy("key").agg(hit.alias("hit"), F.first("n").alias("n"))
    row = per.agg(F.sum(F.least("hit", "n")).alias("hit"), F.sum("n").alias("n")).first()
    return row["hit"] / row["n"] if row["n"] else None
