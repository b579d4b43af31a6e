import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tidemark.operators import contributions as R
from tidemark.operators import estimators as E

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id")
    df = spark.range(400).select("id", F.sin(x * 1.7).alias("a"), F.cos(x * 0.9).alias("b"), (x % 5).cast("double").alias("c"), F.concat(F.lit("g"), (x % 4).cast("string")).alias("g"))
    return df.withColumns({"y": F.col("a") * 3 + F.col("b") * F.col("c"), "k": (F.col("a") + F.col("b") > 0).cast("double"), "k3": (F.col("c") % 3).cast("double")}).persist()


@pytest.mark.parametrize("name, label, params", [
    ("DecisionTreeRegressor", "y", {"maxDepth": 6}), ("RandomForestRegressor", "y", {"numTrees": 7, "maxDepth": 5}), ("GradientBoostingRegressor", "y", {"maxIter": 6, "maxDepth": 3}),
    ("DecisionTreeClassifier", "k", {"maxDepth": 4}), ("RandomForestClassifier", "k3", {"numTrees": 5, "maxDepth": 4}), ("GradientBoostingClassifier", "k", {"maxIter": 5, "maxDepth": 3}),
])
def test_contributions_add_up(rows, name, label, params):
    model = E.fit_family(rows, name, FEATURES, label, params)
    want = {r["id"]: r for r in model.transform(rows).collect()}
    got = R.feature_contributions(model, rows, FEATURES, ["id"]).collect()
    assert len(got) == 400
    for r in got:
        assert r["total"] == pytest.approx(r["base"] + sum(r[f] for f in FEATURES))
        w = want[r["id"]]
        if name == "GradientBoostingClassifier":
            assert 1 / (1 + math.exp(-2 * r["total"])) == pytest.approx(w["probability"][1])
        else:
            assert r["total"] == pytest.approx(w["probability"][1] if name.endswith("Classifier") else w["prediction"])


def test_one_split_by_hand(spark):
    """A tree of one split: its feature gets the whole change, the other nothing."""
    df = spark.createDataFrame([(i, float(i), 0.0, 10.0 if i < 6 else 22.0) for i in range(8)], "id long, a double, b double, y double")
    model = E.fit_family(df, "DecisionTreeRegressor", ["a", "b"], "y", {"maxDepth": 1})
    got = {r["id"]: r for r in R.feature_contributions(model, df, ["a", "b"], ["id"]).collect()}
    assert got[0]["base"] == 13.0 and got[0]["a"] == -3.0 and got[7]["a"] == 9.0 and got[7]["b"] == 0.0
    summary = {r["feature"]: (r["mean_size"], r["mean"]) for r in R.contribution_summary(R.feature_contributions(model, df, ["a", "b"]), ["a", "b"]).collect()}
    assert summary == {"a": (4.5, 0.0), "b": (0.0, 0.0)}


def test_splits_on_categories(rows):
    df = rows.withColumn("label", F.when(F.col("g").isin("g1", "g3"), 5.0).otherwise(1.0) + F.col("a"))
    stages = [StringIndexer(inputCol="g", outputCol="gi"), VectorAssembler(inputCols=["gi", "a"], outputCol="features"), DecisionTreeRegressor(maxDepth=5)]
    model = Pipeline(stages=stages).fit(df)
    assert R.forest_of(model.stages[-1]).categories
    want = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    got = R.feature_contributions(model, df, ["gi", "a"], ["id"]).collect()
    assert all(r["total"] == pytest.approx(want[r["id"]]) for r in got)
    with pytest.raises(ValueError):
        R.forest_of(model.stages[0])
