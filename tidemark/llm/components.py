"""Connected components of a graph that no single machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (a, b); a component is named by one of its nodes.

    Rounds of contraction: every node takes the name of the neighbour, or
    itself, that comes first in a fixed random order, and the edges between
    different names go on. A constant share of the names goes each round. A
    node with very many edges is one group of an aggregate with partial sums,
    and a key of joins that adaptive execution splits. Edges with a missing end
    and loops link nothing.
    """
    ends = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    live = stored(ends.where("a <> b").distinct())
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("_m")).select("a", F.least("_m", order("a"))["n"].alias("to"))
        first = stored(first)
        rounds.append(first.withColumnRenamed("a", "node"))
        left = live.join(first.select("a", F.col("to").alias("x")), "a").select("x", "b")
        right = left.join(first.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        live = stored(right.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        kind = edges.schema["a"].dataType
        return edges.sparkSession.createDataFrame([], "node long, component long").select(F.col("node").cast(kind), F.col("component").cast(kind))
    # From the last round back: each name's own name, as far as it goes. Later rounds are ever smaller.
    final = rounds.pop()
    while rounds:
        step = rounds.pop().alias("s")
        later = final.alias("f")
        final = step.join(later, F.col("s.to") == F.col("f.node"), "left").select("s.node", F.coalesce("f.to", "s.to").alias("to"))
    return stored(final.withColumnRenamed("to", "component"))
