"""Bucketed windows equal plain ones, whatever the skew."""

import hashlib
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ordered import dense_codes, number_by_hash, number_by_time, running_by_value


def skewed(spark):
    """One key holds two thirds of the rows."""
    key = F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 11).cast("string")))
    return spark.range(3000).select("id", key.alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))


def test_running_by_value(spark):
    counts = skewed(spark).groupBy("k", "v").agg(F.count("*").alias("n"))
    want = counts.select("k", "v", F.sum("n").over(W.partitionBy("k").orderBy("v")).alias("u"), F.sum("n").over(W.partitionBy("k")).alias("t"))
    for buckets in (1, 5, 64):
        got = running_by_value(counts, ["k"], "v", ["n"], buckets).select("k", "v", "upto_n", "total_n")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_number_by_hash_is_a_permutation_per_key(spark):
    out = number_by_hash(skewed(spark), ["k"], "id")
    for r in out.groupBy("k").agg(F.count("*").alias("n"), F.min("position").alias("a"), F.max("position").alias("b"),
                                  F.count_distinct("position").alias("d"), F.max("group_size").alias("g")).collect():
        assert r["a"] == 1 and r["b"] == r["n"] == r["d"] == r["g"]


def test_number_by_time(spark):
    df = skewed(spark).withColumn("ts", F.timestamp_seconds(F.col("v") * 60))
    want = df.select("id", F.row_number().over(W.partitionBy("k").orderBy("ts", "id")).alias("p"))
    for buckets in (1, 9):
        got = number_by_time(df, ["k"], "ts", "id", buckets=buckets).select("id", "position")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    back = df.select("id", F.row_number().over(W.partitionBy("k").orderBy(F.desc("ts"), F.desc("id"))).alias("p"))
    got = number_by_time(df, ["k"], "ts", "id", newest_first=True, buckets=9).select("id", "position")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, back.collect()))


def test_null_keys_are_kept(spark):
    from tidemark.operators.monitor import series_changes

    df = skewed(spark).withColumn("k", F.when(F.col("k") != "hot", F.col("k"))).withColumn("ts", F.timestamp_seconds("v"))
    assert number_by_hash(df, ["k"], "id").count() == 3000
    assert number_by_time(df, ["k"], "ts", "id", buckets=6).count() == 3000
    a = series_changes(df, ["k"], "ts", "v", "id", buckets=6).select("id", "previous").collect()
    assert sorted(map(str, a)) == sorted(map(str, series_changes(df, ["k"], "ts", "v", "id", buckets=1).select("id", "previous").collect()))


def test_dense_codes(spark):
    df = spark.range(2000).select(F.concat(F.lit("v"), (F.col("id") * 13 % 500).cast("string")).alias("c"))
    want = {v: i for i, v in enumerate(sorted({r["c"] for r in df.collect()}))}
    assert {r["c"]: r["code"] for r in dense_codes(df, "c").collect()} == want


def test_quantiles_of_every_size(spark):
    import numpy as np

    from tidemark.functions.quantiles import quantiles

    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    sizes = [*range(1, 51), 1498]
    columns = {f"n{n}": [round((i * 7919 + n) % 1013 / 7.0, 4) for i in range(n)] for n in sizes}
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(max(sizes))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    # At the default accuracy, and so that all but the smallest go through brackets.
    for accuracy in (10_000, 20):
        got = {r["feature"]: r["q"] for r in quantiles(df, list(columns), probs, accuracy=accuracy).collect()}
        for c, values in columns.items():
            assert np.allclose(got[c], np.quantile(values, probs)), (c, accuracy)


@pytest.mark.parametrize("kind", ["string", "long", "double"])
def test_number_by_hash_follows_the_hash(spark, kind):
    """Positions by MD5 of every key, null keys too; an id that no later step reads is not moved."""
    rows = [(float(i), None if i % 5 == 0 else f"k{i % 3}", i * 0.5) for i in range(700)]
    df = spark.createDataFrame(rows, "id double, k string, v double").withColumn("id", F.col("id").cast(kind))
    out = number_by_hash(df, ["k"], "id", seed=9)
    text = {r["id"]: r["t"] for r in df.select("id", F.col("id").cast("string").alias("t")).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["k"], []).append((hashlib.md5(f"{text[r['id']]}|9".encode()).hexdigest(), r["id"]))
    want = {i: (n, len(g)) for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    got = {r["id"]: (r["position"], r["group_size"]) for r in out.collect()}
    assert got == want and out.dtypes[-2:] == [("position", "bigint"), ("group_size", "bigint")]
    if kind != "double":
        plan = out.select("v", "position")._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"windowspecdefinition\([^)]*\bid#", plan)
