import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import estimators as E
from tidemark.operators import tuning as T
from tidemark.operators.samplers import MedianPruner, ParzenDraws, RandomDraws, sampler

SPACE = {"x": ("float", -5.0, 5.0), "n": ("int", 1, 40), "kind": ("choice", ["a", "b", "c", "d"])}


def cost(p):
    return (p["x"] - 1.7) ** 2 + ((p["n"] - 31) / 8) ** 2 + {"a": 2.0, "b": 0.0, "c": 1.0, "d": 3.0}[p["kind"]]


def run(chooser, seed, trials=40):
    rng, losses = random.Random(seed), []
    for _ in range(trials):
        p = chooser.suggest(SPACE, rng)
        assert -5 <= p["x"] <= 5 and p["n"] in range(1, 41) and p["kind"] in "abcd"
        losses.append(cost(p))
        chooser.learn(p, losses[-1])
    return losses


def test_guided_draws_beat_random_ones():
    guided = [min(run(ParzenDraws(), s)) for s in range(60)]
    chance = [min(run(RandomDraws(), s)) for s in range(60)]
    assert statistics.mean(guided) < 0.75 * statistics.mean(chance)
    assert statistics.median(guided) < 0.5 * statistics.median(chance)
    assert sum(g < c for g, c in zip(guided, chance)) >= 38


def test_same_seed_same_trials():
    assert run(ParzenDraws(), 3) == run(ParzenDraws(), 3) != run(ParzenDraws(), 4)
    with pytest.raises(ValueError):
        sampler("other")


def test_failures_and_edges_of_a_space():
    chooser, rng = ParzenDraws(startup=2), random.Random(1)
    space = {"k": ("int", 3, 3), "x": ("float", 1.0, 1.0), "c": ("choice", [[50], [100]])}
    for loss in (None, float("nan"), 1.0, 1.0, 0.5):
        p = chooser.suggest(space, rng)
        assert p["k"] == 3 and p["x"] == 1.0 and p["c"] in ([50], [100])
        chooser.learn(p, loss)
    assert chooser.suggest({}, rng) == {}


def test_pruner_compares_after_as_many_folds():
    pruner = MedianPruner(startup=3)
    assert not pruner.ready and not pruner.hopeless([99.0])
    for path in ([1.0, 1.0, 1.0], [2.0, 2.0, 2.0], [3.0]):
        pruner.keep(path)
    assert pruner.ready and pruner.hopeless([2.5]) and not pruner.hopeless([2.0])
    # After two folds only two trials are left to compare with.
    assert not pruner.hopeless([9.0, 9.0])


def test_search_prunes_and_repeats(spark):
    """A made-up family whose quality follows one parameter: bad trials are given up, and the best is found."""
    df = spark.range(120).select("id", F.sin(F.col("id") * 1.7).alias("f"), (F.sin(F.col("id") * 1.7) + F.cos(F.col("id") * 3.1) / 4 > 0).cast("double").alias("label")).persist()

    def build(params, context):
        from pyspark.ml.classification import DecisionTreeClassifier

        return DecisionTreeClassifier(maxDepth=5 if params["x"] > 0.8 else 1, minInstancesPerNode=1 if params["x"] > 0.8 else int(1 + 50 * (1 - params["x"])), seed=1)

    E.register_family("Made", E.Family("classification", build, {"x": ("float", 0.0, 1.0)}))
    try:
        one, two = (T.search(df, ["f"], "label", "id", models=["Made"], trials=12, patience=12, folds=3, startup=4) for _ in range(2))
        rows = [r.asDict() for r in one.trials.orderBy("trial").collect()]
        again = [r.asDict() for r in two.trials.orderBy("trial").collect()]
        same = ("params", "score", "status")
        assert [[r[c] for c in same] for r in rows] == [[r[c] for c in same] for r in again]
        assert {r["status"] for r in rows} <= {"completed", "pruned"} and all(r["score"] is not None for r in rows)
        done = [r["score"] for r in rows if r["status"] == "completed"]
        assert one.score == max(done) and len(done) >= 5
        plain = T.search(df, ["f"], "label", "id", models=["Made"], trials=3, folds=3, draws="random", prune=False)
        assert plain.trials.where("status = 'completed'").count() == 3
    finally:
        del E.FAMILIES["Made"]


@pytest.mark.parametrize("metric", ["auc", "f1"])
def test_search_by_metric(spark, metric):
    df = spark.range(200).select("id", F.sin(F.col("id") * 1.7).alias("f"), (F.sin(F.col("id") * 1.7) + F.cos(F.col("id") * 3.1) > 0).cast("double").alias("label")).persist()
    result = T.search(df, ["f"], "label", "id", models=["GaussianNB", "LogisticRegression"], metric=metric, trials=1, folds=3)
    assert result.metric == metric and 0.6 < result.score <= 1 and result.trials.count() == 2


def test_stages_are_fitted_once_a_fold(spark, monkeypatch):
    """No stage hangs on the parameters of a trial; the rows of a small table are held in one task."""
    from tidemark.operators import prepare, tuning

    fits, parts = [], []
    plain = prepare.Scaler._fit
    monkeypatch.setattr(prepare.Scaler, "_fit", lambda self, df: fits.append(1) or parts.append(df.rdd.getNumPartitions()) or plain(self, df))
    rows = [(i, float(i % 7), float(i % 3), float(i % 7 > 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    found = tuning.search(
        df, ["a", "b"], "label", "id", models=["DecisionTreeClassifier"], trials=3, folds=2, prune=False,
        stages=[prepare.Scaler("standard", ["a", "b"])],
    )
    assert found.trials.where("status = 'completed'").count() > 1
    assert len(fits) == 2 + 1 and set(parts) == {1}


def test_large_table_is_held_once(spark, monkeypatch):
    """Beyond a count of rows one narrow copy is written and no fold is a copy of its own; the trials are the same."""
    from pyspark.sql.classic.dataframe import DataFrame

    from tidemark.operators import tuning

    rows = [(f"r{i}", i % 7, float(i % 3), i % 7 * 2.0 + i % 3 + (i * 37 % 11) / 10, "x" * 50) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, a int, b double, y double, more string")
    find = lambda stages=(): tuning.search(
        df, ["a", "b"], "y", "id", task="regression", models=["LinearRegression", "Ridge"], trials=2, folds=3, metric="rmse", stages=stages
    )
    held, tables = [], []
    plain_persist, plain_written = DataFrame.persist, tuning.written if hasattr(tuning, "written") else None
    small = find()
    monkeypatch.setattr(tuning, "HELD_ROWS", 100, raising=False)
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: held.extend([self.columns] if "more" in self.columns or "fold" in self.columns else []) or plain_persist(self, *a))
    monkeypatch.setattr(tuning, "written", lambda t, name: tables.append(t.columns) or plain_written(t, name), raising=False)
    large = find()
    assert not held and [sorted(t) for t in tables] == [["a", "b", "fold", "label"]]
    same = ("trial", "model", "params", "status")
    was, now = (sorted(r.trials.collect(), key=lambda x: x["trial"]) for r in (small, large))
    assert [[x[c] for c in same] for x in was] == [[x[c] for c in same] for x in now]
    assert [x["score"] for x in now] == pytest.approx([x["score"] for x in was], rel=1e-9)
    assert large.metrics == pytest.approx(small.metrics, rel=1e-9)
    # A stage may read any column, so all of them are kept.
    from tidemark.operators.prepare import Scaler

    assert find([Scaler("standard", ["a", "b"])]).trials.count() == len(now) and not held
    assert sorted(tables[1]) == ["a", "b", "fold", "id", "label", "more", "y"]


def test_neighbours_of_a_large_table_keep_the_id(spark, monkeypatch):
    from tidemark.operators import tuning

    df = spark.range(90).select("id", F.sin(F.col("id") * 1.7).alias("f"), (F.sin(F.col("id") * 1.7) > 0).cast("double").alias("label"))
    find = lambda: tuning.search(df, ["f"], "label", "id", models=["KNeighborsClassifier"], trials=1, folds=2)
    small = find().score
    monkeypatch.setattr(tuning, "HELD_ROWS", 10, raising=False)
    assert find().score == pytest.approx(small)
