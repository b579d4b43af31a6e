import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import normalise
from tidemark.functions.quantiles import modes, quantiles
from tidemark.operators import profile as P


def rows(df, key="feature"):
    return {r[key]: r for r in df.collect()}


def test_known_skew(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 3, 10)], "x double")
    r = rows(P.numeric_profile(df))["x"]
    assert r["skew"] == pytest.approx(2.159962090793934)
    assert r["kurtosis"] == pytest.approx(4.965499170233208)
    assert r["std"] == pytest.approx(3.271085446759225)
    d = rows(P.describe(df))["x"]
    assert (d["q25"], d["q50"]) == (2.0, 2.5)


def test_correlation_skips_incomplete_rows_and_constants(spark):
    df = spark.createDataFrame([(1.0, None, 7.0), (1.0, 2.0, 7.0), (2.0, 5.0, 7.0), (3.0, 1.0, 7.0)], "a double, b double, c double")
    r = {(x["a"], x["b"]): x["r"] for x in P.correlations(df).collect()}
    assert r["a", "b"] == pytest.approx(-0.2401922307076307)
    assert r["a", "c"] is None and r["b", "c"] is None


def test_one_row_and_empty(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    r = rows(P.describe(one))["x"]
    assert r["std"] is None and r["q25"] == 1.0
    empty = one.limit(0)
    r = rows(P.describe(empty))["x"]
    assert r["count"] == 0 and r["mean"] is None and r["q50"] is None
    assert P.duplicate_rows(empty).first()["rows"] == 0
    assert P.outlier_counts(empty).first()["outliers"] == 0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (3.0,)], "x double")
    assert rows(P.null_counts(df))["x"]["missing"] == 2
    assert rows(P.describe(df))["x"]["mean"] == 2.0
    assert normalise(df).where("x IS NULL").count() == 2
    assert rows(P.distinct_counts(df))["x"]["distinct"] == 2


def test_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (2.0, "b"), (3.0, "a"), (3.0, None)], "x double, c string")
    assert rows(modes(df, ["x"], text=False))["x"]["value"] == 2.0
    assert rows(modes(df, ["c"], text=True))["c"]["value"] == "a"


@pytest.mark.parametrize("buckets", [1, 7])
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_bracketed_quantiles_equal_the_direct_ones(spark, buckets, accuracy):
    """A coarse sketch leaves wide brackets; a hot value fills a third of the rows."""
    hot = F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pow(F.col("id") % 977, 2) / 7)
    df = spark.range(20_000).select(hot.alias("x"), F.when(F.col("id") % 4 > 0, F.sin("id")).alias("y"), F.lit(None).cast("double").alias("z"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = rows(quantiles(df, ["x", "y", "z"], probs, buckets=buckets, accuracy=accuracy))
    for c in ("x", "y"):
        want = df.agg(F.percentile(c, F.array(*map(F.lit, probs)))).first()[0]
        assert got[c]["q"] == pytest.approx(want, abs=1e-12)
        assert got[c]["n"] == df.where(F.col(c).isNotNull()).count()
    assert got["z"]["q"] == [None] * len(probs)


def test_histogram_counts_every_value_once(spark):
    df = spark.range(1000).select((F.col("id") % 50).cast("double").alias("x"), F.lit(3.0).alias("flat"))
    h = P.histogram(df, ["x", "flat"], 30)
    totals = {r["feature"]: r["n"] for r in h.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    assert totals == {"x": 1000, "flat": 1000}
    assert h.agg(F.max("bin")).first()[0] == 29


def test_duplicates_see_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (1, None)], "x int, c string")
    assert P.duplicate_rows(df).first().asDict() == {"rows": 4, "duplicates": 1}


def test_shares_by_both_denominators(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert {r["value"]: r["share"] for r in P.value_shares(df, "c").collect()}["a"] == pytest.approx(2 / 3)
    assert {r["value"]: r["share"] for r in P.value_shares(df, "c", of_all_rows=True).collect()}["a"] == 0.5


def test_matrix_diagonal(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    own = {r["a"]: r["r"] for r in P.correlation_matrix(df).where("a = b").collect()}
    assert own == {"a": 1.0, "b": None}
    assert not math.isnan(own["a"])


def test_samples_are_repeatable(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 2 == 0, 1).alias("x"))
    a = P.missing_pattern_sample(df, "id", 20).collect()
    assert a == P.missing_pattern_sample(df.repartition(5), "id", 20).collect() and len(a) == 20
